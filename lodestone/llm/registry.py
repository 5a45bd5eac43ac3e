"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import anchors, decontam, divergence, exact, jaccard, langid, phrases, pii, piece_codec, quality, shards, suffixes, urls

QUERIES = {
    f.__name__: f
    for f in (
        piece_codec.op1_sentencepiece,
        jaccard.op2_jaccard_join,
        pii.op3_semi_crf_pii,
        exact.op4_exact_dedup,
        anchors.op5_block_anchors,
        suffixes.op6_suffix_sort,
        urls.op7_link_graph_filter,
        langid.op8_language_id,
        shards.op9_feistel_shards,
        decontam.op10_decontaminate,
        divergence.op11_source_divergence,
        phrases.op12_phrase_collocations,
        quality.op13_adaptive_quality,
    )
}
ORACLE_SQL = {"op2_jaccard_join": jaccard.SQL, "op4_exact_dedup": exact.SQL, "op5_block_anchors": anchors.SQL, "op6_suffix_sort": suffixes.SQL, "op7_link_graph_filter": urls.SQL, "op9_feistel_shards": shards.SQL, "op10_decontaminate": decontam.SQL, "op11_source_divergence": divergence.SQL, "op12_phrase_collocations": phrases.SQL, "op13_adaptive_quality": quality.SQL}
