"""The queries of this subpackage, by their registered names, and their SQL."""

from __future__ import annotations

from quire.llm.block_max import OP13_SQL, op13_block_max_search
from quire.llm.decontaminate import OP5_SQL, op5_template_decontamination
from quire.llm.html_density import op8_html_density
from quire.llm.jaccard_join import OP11_SQL, op11_jaccard_join
from quire.llm.language_id import op4_language_id
from quire.llm.licenses import op9_license_scan, op9_sql
from quire.llm.matroska import op6_matroska
from quire.llm.near_dedup import op10_minhash_near_dedup
from quire.llm.packing import op7_curve_packing
from quire.llm.pii import op3_pii_crf
from quire.llm.recompression_dedup import op2_recompression_dedup
from quire.llm.rolling_users import OP12_SQL, op12_rolling_users
from quire.llm.suffix_dedup import op1_suffix_dedup


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_recompression_dedup": op2_recompression_dedup,
        "op3_pii_crf": op3_pii_crf,
        "op4_language_id": op4_language_id,
        "op5_template_decontamination": op5_template_decontamination,
        "op6_matroska": op6_matroska,
        "op7_curve_packing": op7_curve_packing,
        "op8_html_density": op8_html_density,
        "op9_license_scan": op9_license_scan,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_rolling_users": op12_rolling_users,
        "op13_block_max_search": op13_block_max_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_template_decontamination": OP5_SQL, "op9_license_scan": op9_sql(), "op11_jaccard_join": OP11_SQL, "op12_rolling_users": OP12_SQL, "op13_block_max_search": OP13_SQL}
