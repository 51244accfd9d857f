"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_minhash_containment
from .language import language_id_pages, op3_language_id
from .licenses import OP10_SQL, op10_license_sentences
from .quality import OP9_SQL, op9_line_frequency_rules
from .sentencepiece import op5_sentencepiece_paths
from .sharding import op2_bounded_ring_shards
from .simhash import op7_simhash_near_dedup
from .toxicity import op1_crf_toxicity
from .warc import OP6_SQL, op6_arc_to_warc
from .winnowing import op4_winnowed_lines


def queries() -> dict:
    return {
        "op1_crf_toxicity": op1_crf_toxicity,
        "op2_bounded_ring_shards": op2_bounded_ring_shards,
        "op3_language_id": op3_language_id,
        "op3_language_id_pages": language_id_pages,
        "op4_winnowed_lines": op4_winnowed_lines,
        "op5_sentencepiece_paths": op5_sentencepiece_paths,
        "op6_arc_to_warc": op6_arc_to_warc,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_minhash_containment": op8_minhash_containment,
        "op9_line_frequency_rules": op9_line_frequency_rules,
        "op10_license_sentences": op10_license_sentences,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_arc_to_warc": OP6_SQL, "op8_minhash_containment": OP8_SQL, "op9_line_frequency_rules": OP9_SQL, "op10_license_sentences": OP10_SQL}
