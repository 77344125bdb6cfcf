"""The queries of this subpackage and their SQL."""

from . import decontaminate, substring, suffix, warc
from .audio import op10_audio
from .decontaminate import op1_decontaminate
from .mixing import op5_mix_sources
from .pii import op2_pii
from .quality import op7_quality
from .sharding import op6_shard
from .simhash import op9_simhash
from .substring import op3_substring_dedup
from .suffix import op8_suffix_dedup
from .warc import op4_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_warc": op4_warc,
    "op5_mix_sources": op5_mix_sources,
    "op6_shard": op6_shard,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_audio": op10_audio,
}

ORACLES = {"op1_decontaminate": decontaminate.ORACLE_SQL, "op3_substring_dedup": substring.ORACLE_SQL, "op4_warc": warc.ORACLE_SQL, "op8_suffix_dedup": suffix.ORACLE_SQL}
