"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import op3_query
from .decontaminate import op10_query
from .fingerprints import op7_query
from .mixing import op9_query
from .neardup import op1_query
from .oracles import OP1_SQL, OP5_SQL, OP9_SQL
from .repeats import op5_query
from .secrets import op2_query
from .sharding import OP4_SQL, op4_query
from .tokens import op8_query
from .toxicity import op6_query

QUERIES = {
    "op1_jaccard_join": op1_query,
    "op2_secrets": op2_query,
    "op3_chat": op3_query,
    "op4_sharding": op4_query,
    "op5_repeats": op5_query,
    "op6_toxicity": op6_query,
    "op7_fingerprints": op7_query,
    "op8_tokens": op8_query,
    "op9_mixing": op9_query,
    "op10_decontamination": op10_query,
}

ORACLE_SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op4_sharding": OP4_SQL,
    "op5_repeats": OP5_SQL,
    "op9_mixing": OP9_SQL,
}
