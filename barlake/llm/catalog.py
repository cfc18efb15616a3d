"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from barlake.llm import bpe, exact, html, lexical, licenses, lm, mixing, quality, secrets, shards, simhash, spelling, topk

QUERIES = {
    "op10_html_layout": html.op10_html_layout,
    "op11_dual_tree": lexical.op11_dual_tree,
    "op12_trie_pairs": spelling.op12_trie_pairs,
    "op13_bloom_exact": exact.op13_bloom_exact,
    "op1_line_quality": quality.op1_line_quality,
    "op2_secret_links": secrets.op2_secret_links,
    "op3_context_tree": lm.op3_context_tree,
    "op4_norm_buckets": topk.op4_norm_buckets,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_bpe_chunks": bpe.op6_bpe_chunks,
    "op7_simhash_trie": simhash.op7_simhash_trie,
    "op8_shard_lookup": shards.op8_shard_lookup,
    "op9_license_scan": licenses.op9_license_scan,
}
CHECKS = {
    "op11_dual_tree": lexical.check_op11(),
    "op12_trie_pairs": spelling.check_op12(),
    "op13_bloom_exact": exact.check_op13(),
    "op1_line_quality": quality.check_op1(),
    "op2_secret_links": secrets.check_op2(),
    "op4_norm_buckets": topk.check_op4(),
    "op8_shard_lookup": shards.check_op8(),
}
