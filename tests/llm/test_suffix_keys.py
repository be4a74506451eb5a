"""Rows of one id whose texts collide in 32 bits keep their own spans."""

from pyspark.sql import functions as F

from shelfline.llm import suffixes


def test_texts_of_one_id_that_collide(spark, documents):
    passage = " ".join(f"word{i}" for i in range(60))
    long, short = f"{passage} 14901", "other text 155949"
    df = documents([(7, long, "a"), (7, short, "a"), (8, f"{passage} elsewhere", "a")])
    hashes = df.where("doc_id = 7").select(F.hash("doc_id", "text").alias("h")).distinct()
    assert hashes.count() == 1
    got = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in suffixes.remove_repeats(df, with_text=True).collect()}
    assert got == {(7, len(long)): b"14901", (7, len(short)): short.encode(), (8, len(passage) + 10): b"elsewhere"}
