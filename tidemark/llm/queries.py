"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from .byte_bpe import op3_byte_bpe
from .collocations import OP13_SQL, op13_collocations
from .conversations import OP11_SQL, op11_conversation_repair
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_text import op1_html_text
from .language_id import op9_language_id
from .license_scan import OP12_SQL, op12_license_scan
from .mixing import OP5_SQL, op5_mixing
from .ngram_join import op6_ngram_join
from .quality_rules import OP7_SQL, op7_quality_rules
from .suffix_dedup import op10_suffix_dedup
from .token_orc import op2_token_orc
from .warc import op4_warc

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_token_orc": op2_token_orc,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": op6_ngram_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_collocations": op13_collocations,
}
ORACLES = {"op5_mixing": OP5_SQL, "op7_quality_rules": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_collocations": OP13_SQL}
