"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import functools

from .bpe_codec import op1_bpe
from .bpe_counts import op7_tokens
from .collocations import ORACLE as PHRASES_SQL
from .collocations import op12_phrases
from .filter_audit import ORACLE as AUDIT_SQL
from .filter_audit import op11_filter_audit
from .jaccard_join import op10_jaccard
from .kneser_ney import op4_quality
from .language_id import op9_language
from .mixing import op5_mix
from .personal_data import op3_personal_data
from .quality_rules import op2_rules
from .range_join import op8_vectors
from .secret_scan import op13_secrets
from .store import ship_package
from .substring_dedup import op6_repeats


def _with_package(query):
    """The query, with this package sent to the executors first."""

    @functools.wraps(query)
    def run(spark, sf_dir: str):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_ALL = {
    "op1_bpe": op1_bpe,
    "op2_rules": op2_rules,
    "op3_personal_data": op3_personal_data,
    "op4_quality": op4_quality,
    "op5_mix": op5_mix,
    "op6_repeats": op6_repeats,
    "op7_tokens": op7_tokens,
    "op8_vectors": op8_vectors,
    "op9_language": op9_language,
    "op10_jaccard": op10_jaccard,
    "op11_filter_audit": op11_filter_audit,
    "op12_phrases": op12_phrases,
    "op13_secrets": op13_secrets,
}

QUERIES = {name: _with_package(query) for name, query in _ALL.items()}

ORACLES: dict[str, str] = {"op11_filter_audit": AUDIT_SQL, "op12_phrases": PHRASES_SQL}
