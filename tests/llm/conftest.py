"""A small folder of tables with the awkward cases, and plain versions of words."""

import random
import re

import pytest

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(UP)


def solid(text):
    return SOLID.findall(low(text))


def alnum(text):
    return ALNUM.findall(low(text))


def prose(seed, n, words=400):
    draw = random.Random(seed)
    return " ".join(f"w{min(draw.randrange(words), draw.randrange(words))}" for _ in range(n))


def awkward():
    """(doc_id, text, source): nulls, empties, ties, repeats, a very long text, odd characters."""
    rows = [(i, prose(i, 20 + i % 60), f"s{i % 5}") for i in range(1, 120)]
    rows += [(200 + i, rows[3][1], "hot") for i in range(40)]  # a group of copies
    rows += [(300 + i, rows[5][1].upper(), "hot") for i in range(3)]
    rows += [(400 + i, prose(77, 400) + f" tail{i}", "s1") for i in range(4)]  # near copies
    rows += [
        (500, None, "s1"), (501, "", "s2"), (502, " \t\n\r ", None), (503, None, None), (504, "one", ""), (505, "Ünïcode É é ß   x", "s3"),
        (506, prose(9, 60_000), "s4"), (507, "a b c", "s0"), (507, "a b c", "s0"), (507, "other text of the same id", "s0"), (None, "no id", "s0"),
        (508, "x" * 100_000, "s2"), (509, "tie tie", "s2"), (510, "<|endoftext|> in a text!", "s2"), (511, "A  B\n C", "s2")]
    return rows


def vectors():
    """(vec_id, embedding, n): repeats, nulls, holes, odd lengths, a null key."""
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1 + k % 3) for k in range(20)], 0) for i in range(90)]
    rows += [(100 + i, rows[0][1], 0) for i in range(30)] + [(None, rows[1][1], 0), (7, rows[2][1], 0)]
    holes = [None, [], [1.0] * 19, [None] + [1.0] * 19, [float("nan")] + [1.0] * 19, [float("-inf")] + [1.0] * 19]
    return rows + [(200 + i, v, 0) for i, v in enumerate(holes)]


def turns():
    """(conv_id, turn, role, text, place): conversations with faults of every kind, one longer than a block."""
    draw, rows = random.Random(5), []
    texts = ["Yes.", "No", "Why?  ", " ", "", None, "Tell me.\n", "a! b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    for conv in range(120):
        for turn in range(draw.randrange(1, 6)):
            role = draw.choice(roles) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = draw.choice(texts) if draw.random() < 0.4 else f"word {draw.randrange(99)}."
            rows.append((conv, turn if draw.random() < 0.9 else draw.choice([None, 9, turn]), role, text, 1))
    rows += [(500, k, ("user", "assistant")[(k + k // 70) % 2], f"turn {k % 1500}" + "." * (k % 9 > 0), 1) for k in range(2500)]
    rows += [(None, 1, "user", "Hi!", 1), (None, None, None, None, 1), (600, 1, "user", "x" * 100_000, 1), (600, 2, "assistant", "Same.", 1), (600, 2, "assistant", "Same.", 1)]
    return rows


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if not extra:
        return df
    from pyspark.sql import functions as F

    names = ("lang", "n_chars", "size", "key", "fp", "row", "node", "digest", "shard", "score", "features", "copies", "row_key", "place", "first", "bytes")
    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A table folder with the awkward documents; labels and benchmark items go with them."""
    root = str(tmp_path_factory.mktemp("tables"))
    rows = awkward()
    documents(spark, rows).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(1, 120)] + [(None, 1, 1), (3, 1, None), (5, 0, 0), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [(1, " ".join(rows[10][1].split()[:20])), (2, None), (3, "too short"), (4, prose("item", 30)), (4, prose("item", 30)), (5, "an item of seven words in all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, n int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string, place int").repartition(5).write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The same tables without rows."""
    root = str(tmp_path_factory.mktemp("empty"))
    documents(spark, []).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, n int").write.parquet(f"{root}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string, place int").write.parquet(f"{root}/conversations.parquet")
    return root
