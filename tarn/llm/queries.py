"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .audio import op7_audio
from .bpe import op5_bpe
from .divergence import OP12_SQL, op12_source_divergence
from .html import op1_html
from .langid import op3_language_id
from .lattice import op10_embeddings
from .mixing import OP2_SQL, op2_mixing
from .pii import op4_pii
from .ranked import OP11_SQL, op11_ranked_search
from .sharding import OP9_SQL, op9_sharding
from .simhash import op8_simhash
from .suffixes import op6_suffix_dedup
from .tokenfiles import op13_token_orc

QUERIES = {
    "op1_html": op1_html,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_audio": op7_audio,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_embeddings": op10_embeddings,
    "op11_ranked_search": op11_ranked_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_orc": op13_token_orc,
}

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op9_sharding": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_source_divergence": OP12_SQL}
