"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontamination import OP6_SQL, op6_decontamination
from .lines import op3_line_dedup
from .neighbours import OP13_SQL, op13_neighbours
from .packing import op4_packing
from .pii import op5_pii
from .quality import op7_quality
from .search import OP11_SQL, op11_search
from .sharding import op9_sharding
from .simhash import op1_simhash
from .sstable import op8_sstable
from .token_counts import op10_token_counts
from .trie import OP12_SQL, op12_trie
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op3_line_dedup": op3_line_dedup,
    "op7_quality": op7_quality,
    "op2_warc": op2_warc,
    "op10_token_counts": op10_token_counts,
    "op4_packing": op4_packing,
    "op8_sstable": op8_sstable,
    "op1_simhash": op1_simhash,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op9_sharding": op9_sharding,
    "op11_search": op11_search,
    "op12_trie": op12_trie,
    "op13_neighbours": op13_neighbours,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op6_decontamination": OP6_SQL,
    "op11_search": OP11_SQL,
    "op12_trie": OP12_SQL,
    "op13_neighbours": OP13_SQL,
}
