"""The registered queries of this folder with their SQL twins."""

from __future__ import annotations

from shelfline.llm import fingerprints, hilbert, licences, mixing, packing, pii, pq_dedup, quality, repair, secret_scan, simhash, suffixes, trie
from shelfline.sources.star import read_table


def op1_secrets(spark, folder):
    return secret_scan.scan(read_table(spark, folder, "documents"))


def op2_suffixes(spark, folder):
    return suffixes.remove_repeats(read_table(spark, folder, "documents"))


def op3_pii(spark, folder):
    return pii.scan(read_table(spark, folder, "documents"))


def op4_packing(spark, folder):
    return packing.pack(read_table(spark, folder, "documents"))


def op5_licences(spark, folder):
    return licences.scan_licences(read_table(spark, folder, "documents"))


def op6_mixing(spark, folder):
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark, folder):
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


def op8_pq(spark, folder):
    return pq_dedup.near_duplicates(read_table(spark, folder, "embeddings"))


def op9_quality(spark, folder):
    return quality.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op10_hilbert(spark, folder):
    return hilbert.search(read_table(spark, folder, "embeddings"))


def op11_trie(spark, folder):
    return trie.prefix_trie(trie.rebuilt(read_table(spark, folder, "conversations")))


def op12_repair(spark, folder):
    return repair.repair(repair.damaged(read_table(spark, folder, "conversations")))


def op13_fingerprints(spark, folder):
    return fingerprints.fingerprint_edits(read_table(spark, folder, "documents"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_suffixes": op2_suffixes,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_licences": op5_licences,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_pq": op8_pq,
    "op9_quality": op9_quality,
    "op10_hilbert": op10_hilbert,
    "op11_trie": op11_trie,
    "op12_repair": op12_repair,
    "op13_fingerprints": op13_fingerprints,
}

ORACLES = {
    "op5_licences": licences.oracle(),
    "op6_mixing": mixing.oracle(),
    "op11_trie": trie.oracle(),
    "op12_repair": repair.oracle(),
}
