"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from .attribution import op5_attribution
from .bpe import op4_bpe
from .chat import op9_chat
from .flac import op1_flac
from .mixing import op2_mixing
from .pu import op8_pu_quality
from .quality import op7_quality
from .simhash import op6_simhash
from .substrings import op10_substrings
from .toxicity import op3_toxicity

QUERIES = {
    "op1_flac": op1_flac,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_attribution": op5_attribution,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_pu_quality": op8_pu_quality,
    "op9_chat": op9_chat,
    "op10_substrings": op10_substrings,
}

SQL: dict[str, str] = {}
