"""Queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from . import html_text, inverted_index, jpeg, lines, lloyd, mixing, piece_codec, prefix_trie, quality, repeats, shards, simhash, suffix_tree_lm

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html_text": html_text.op2_html_text,
    "op3_media": jpeg.op3_media,
    "op4_sharding": shards.op4_sharding,
    "op5_repeats": repeats.op5_repeats,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_language_model": suffix_tree_lm.op8_language_model,
    "op9_quality": quality.op9_quality,
    "op10_decontamination": inverted_index.op10_decontamination,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_sentencepiece": piece_codec.op12_sentencepiece,
    "op13_centroid_clustering": lloyd.op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op6_line_dedup": lines.ORACLE,
    "op10_decontamination": inverted_index.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_centroid_clustering": lloyd.ORACLE,
}
