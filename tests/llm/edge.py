"""A small table with the awkward rows every operator has to take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("n", T.StringType()), T.StructField("part", T.StringType())])


def awkward(n: int = 60, seed: int = 5) -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, one very long text, and columns with clashing names."""
    rnd = random.Random(seed)
    words = ["ab", "cde", "f", "über", "ñandú", "don't", "12", "x.y", "中文", "$#", "The"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80))), "n", None) for i in range(n)]
    rows += [(n, None, None, "p"), (n + 1, "", "", ""), (n + 2, " \t\n ", "x", "y"), (None, "a lone text", None, None),
             (n + 3, rows[3][1], "n", None), (n + 3, rows[3][1], "n", None), (n + 4, "a\x00b \x85 c\x0b d", "", "")]
    rows.append((n + 5, " ".join(rnd.choice(words) + rnd.choice(["", "\n", "!"]) for _ in range(30_000)), "n", None))
    return rows
