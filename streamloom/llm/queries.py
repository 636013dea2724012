"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from streamloom.llm.chat import OP4_SQL, op4_chat_format
from streamloom.llm.language import op5_language
from streamloom.llm.minhash import OP10_SQL, op10_minhash
from streamloom.llm.mixing import op3_mix
from streamloom.llm.packing import op1_pack
from streamloom.llm.quality import OP8_SQL, op8_quality_rules
from streamloom.llm.shards import op7_shard
from streamloom.llm.substrings import OP2_SQL, op2_substring_dedup
from streamloom.llm.suffixes import OP6_SQL, op6_suffix_dedup
from streamloom.llm.vectors import OP9_SQL, op9_near_vectors

QUERIES = {f.__name__: f for f in (op1_pack, op2_substring_dedup, op3_mix, op4_chat_format, op5_language, op6_suffix_dedup, op7_shard, op8_quality_rules, op9_near_vectors, op10_minhash)}
SQL = {
    "op2_substring_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_near_vectors": OP9_SQL, "op10_minhash": OP10_SQL,
}
