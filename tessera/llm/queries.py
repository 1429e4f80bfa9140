"""The registered corpus queries: ``(spark, sf_dir) -> DataFrame`` over whole
tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import common as C
from tessera.llm import (chat, chunks, mixing, near, packing, pages, pieces, private, quality, search, spelling, substrings,
                         vectors)


def op1_private_data(spark, sf_dir):
    return private.find_private(C.table(spark, sf_dir, "documents"))


def op2_suffix_array(spark, sf_dir):
    return substrings.dedup_substrings(C.table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return pieces.encode(C.table(spark, sf_dir, "documents"))


def op4_chunking(spark, sf_dir):
    return chunks.dedup_chunks(C.table(spark, sf_dir, "documents"), shortest=1)


def op5_html(spark, sf_dir):
    return pages.extract(C.table(spark, sf_dir, "pages"))


def op6_minhash(spark, sf_dir):
    return near.near_duplicates(C.table(spark, sf_dir, "documents"), n=2)


def op7_quality_rules(spark, sf_dir):
    return quality.quality(C.table(spark, sf_dir, "documents"))


def op8_chat(spark, sf_dir):
    return chat.format_chats(C.table(spark, sf_dir, "conversations"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(C.table(spark, sf_dir, "documents")).drop("source", "tag")


def op10_cover_tree(spark, sf_dir):
    return vectors.near_vectors(C.table(spark, sf_dir, "embeddings"))


def op11_packing(spark, sf_dir):
    return packing.pack(C.table(spark, sf_dir, "documents")).drop("tag")


def op12_search(spark, sf_dir):
    return search.search(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(C.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_private_data, op2_suffix_array, op3_sentencepiece, op4_chunking, op5_html, op6_minhash, op7_quality_rules,
    op8_chat, op9_mixing, op10_cover_tree, op11_packing, op12_search, op13_spelling)}
SQL = {"op9_mixing": mixing.SQL, "op12_search": search.SQL}
