"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .langid import op6_language
from .lattice import op2_lattice
from .licenses import op10_licenses
from .licenses import oracle as op10_oracle
from .negatives import ORACLE as op12_oracle
from .negatives import op12_negatives
from .order_minhash import op5_order_minhash
from .packing import op7_packing
from .periods import op11_periods
from .pii import op8_pii
from .quality import op9_quality
from .repeats import op13_repeats
from .simhash import op1_simhash
from .token_files import op3_token_files

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lattice": op2_lattice,
    "op3_token_files": op3_token_files,
    "op4_bpe": op4_bpe,
    "op5_order_minhash": op5_order_minhash,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_periods": op11_periods,
    "op12_negatives": op12_negatives,
    "op13_repeats": op13_repeats,
}

ORACLES: dict[str, str] = {
    "op10_licenses": op10_oracle(),
    "op12_negatives": op12_oracle,
}
