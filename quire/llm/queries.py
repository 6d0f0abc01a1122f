"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP8_SQL, op8_decontaminate
from .embedding_dedup import OP1_SQL, op1_embedding_dedup
from .html_extract import op4_html_extract
from .line_dedup import OP2_SQL, op2_line_dedup
from .minhash_dedup import OP10_SQL, op10_minhash_dedup
from .mixing import op7_mix
from .quality import op9_quality
from .sharding import op6_shard
from .token_counts import op3_token_counts

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_html_extract": op4_html_extract,
    "op5_chat_format": op5_chat_format,
    "op6_shard": op6_shard,
    "op7_mix": op7_mix,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_minhash_dedup": op10_minhash_dedup,
}
SQL = {
    "op1_embedding_dedup": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op5_chat_format": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_minhash_dedup": OP10_SQL,
}
