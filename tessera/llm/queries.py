"""The corpus queries by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op7_bpe
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_text import op1_html_text
from .language_id import op9_language_id
from .lattice import op4_lattice
from .line_dedup import op5_line_dedup
from .mixing import op2_mixing
from .sharding import op6_sharding
from .simhash import op8_simhash
from .toxicity import op10_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lattice": op4_lattice,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
}
ORACLES = {"op3_exact_dedup": OP3_SQL}
