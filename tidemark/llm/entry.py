"""Queries of this package, one for each numbered operator."""

from . import negatives, prefixes
from .bpe import op12_bpe
from .decontaminate import op10_latent
from .lm import op9_elias_fano
from .minhash import op3_minhash
from .mixing import op5_cube_mix
from .pii import op1_pii
from .quality import op8_cotraining
from .simhash import op4_simhash
from .substrings import op2_automata
from .tokens import op7_bitpack
from .warc import op6_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_automata": op2_automata,
    "op3_minhash": op3_minhash,
    "op4_simhash": op4_simhash,
    "op5_cube_mix": op5_cube_mix,
    "op6_warc": op6_warc,
    "op7_bitpack": op7_bitpack,
    "op8_cotraining": op8_cotraining,
    "op9_elias_fano": op9_elias_fano,
    "op10_latent": op10_latent,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_bpe": op12_bpe,
    "op13_prefix_trie": prefixes.op13_prefix_trie,
}
#: DuckDB SQL of those that SQL can express.
ORACLE = {"op11_hard_negatives": negatives.ORACLE, "op13_prefix_trie": prefixes.ORACLE}
