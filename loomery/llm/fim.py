"""Fill-in-the-middle documents, in DataFrame functions only and without a shuffle.

A text's units are runs of letters A-Z and single other characters. The first four 8-digit groups of the SHA-256 of
`seed:id` give two cuts between units, whether the document stays plain, and the arrangement: prefix-suffix-middle (psm)
or suffix-prefix-middle (spm), with a mark before each part. Texts that hold a mark themselves stay plain, so marks in an
arranged text are ours alone and splitting at them restores the text.

Null texts are empty, and empty ones plain with 0 units. A null id counts as an id without digits. Repeated rows get equal
results, whole texts of any length are cut, and an empty table gives an empty table. Only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a unit is, and the marks before prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")


def draws(key: Column, n: int = 4) -> list[Column]:
    """The first n 8-digit groups of the SHA-256 of key as unsigned integers."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def arranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (null if plain), text, output.

    plain: percent of the documents left as they are; spm: percent of the others that begin with the suffix.
    """
    h = draws(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h)))
    cut = rows.select("*", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    n = F.size("units").cast("long")
    cut = cut.select("*", n.alias("n"), *((F.col(x) % (n + 1)).cast("int").alias(x + "_cut") for x in ("h0", "h1")))
    first, second = F.least("h0_cut", "h1_cut"), F.greatest("h0_cut", "h1_cut")
    part = lambda start, length: F.array_join(F.slice("units", start + 1, length), "")
    marked = [F.contains("text", F.lit(m)) for m in marks]
    stays = (F.col("text") == "") | marked[0] | marked[1] | marked[2] | (F.col("h2") % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(F.col("h3") % 100 < spm, "spm").otherwise("psm")
    parts = cut.select(F.col(id_col), "n", "text", form.alias("form"), part(F.lit(0), first).alias("a"), part(first, second - first).alias("b"), part(second, F.size("units") - second).alias("c"))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "a", s, "c", m, "b")).otherwise(F.concat(s, "c", p, "a", m, "b"))
    chars = [F.when(F.col("form") != "plain", F.length(x).cast("long")).alias(name) for x, name in (("a", "prefix_chars"), ("b", "middle_chars"))]
    return parts.select(F.col(id_col), "n", "form", *chars, "text", output.alias("output"))


def restored(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """made, with output and form, and restored: the text that each output was made from, by its form and marks alone."""
    parts = made.withColumn("_parts", F.split("output", "|".join("\\Q" + m + "\\E" for m in marks)))
    joined = lambda *order: F.concat(*(F.element_at("_parts", i) for i in order))
    text = F.when(F.col("form") == "psm", joined(2, 4, 3)).when(F.col("form") == "spm", joined(3, 4, 2)).otherwise(F.col("output"))
    return parts.withColumn("restored", text).drop("_parts")
