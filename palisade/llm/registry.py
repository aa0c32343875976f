"""Queries of this folder and, where SQL can express them, the same in SQL."""

from palisade.llm.ann import op7_neighbours
from palisade.llm.bpe import op2_bpe
from palisade.llm.jaccard import op3_jaccard
from palisade.llm.language import op6_language
from palisade.llm.lm import op10_lm
from palisade.llm.merkle import op11_merkle
from palisade.llm.passages import op8_passages
from palisade.llm.positional import op5_decontaminate
from palisade.llm.quality import op4_quality
from palisade.llm.secrets import op1_secrets
from palisade.llm.sql import SQL as SQL
from palisade.llm.token_files import op12_token_files
from palisade.llm.toxicity import op9_toxicity
from palisade.llm.vector_codes import op13_vector_codes

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_neighbours": op7_neighbours,
    "op8_passages": op8_passages,
    "op9_toxicity": op9_toxicity,
    "op10_lm": op10_lm,
    "op11_merkle": op11_merkle,
    "op12_token_files": op12_token_files,
    "op13_vector_codes": op13_vector_codes,
}
