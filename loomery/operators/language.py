"""Statistical language detection: naive Bayes over character n-grams, trained on rows of known language."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CharModel:
    """Counts of the `size` most frequent n-grams of each language, add-one smoothed.

    Counting is combined in batches before the shuffle; size rows a language come to the driver. Texts of fewer than
    `least` characters, and all if there is no language, are unknown with probability 0.
    """

    def __init__(self, longest: int = 3, size: int = 2000, least: int = 20):
        self.longest, self.size, self.least = longest, size, least

    def grams(self, text: str) -> Counter:
        t = f" {' '.join(text.lower().split())} "
        return Counter(t[i : i + n] for n in range(1, self.longest + 1) for i in range(len(t) - n + 1))

    def fit(self, df: DataFrame, lang: str, text: str) -> "CharModel":
        def count(batches):
            for b in batches:
                total: Counter = Counter()
                for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for g, n in self.grams(t or "").items():
                        total[name, g] += n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(total.values(), pa.int64())], names=["lang", "gram", "n"])

        counted = df.where(F.col(lang).isNotNull()).select(lang, text).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # tasks keep `size` rows each before the shuffle
        rows = counted.withColumn("place", place).where(F.col("place") <= self.size).select("lang", "gram", "n").orderBy("lang", "gram").collect()
        self.languages = sorted({r["lang"] for r in rows})
        self.index = {g: i for i, g in enumerate(sorted({r["gram"] for r in rows}))}
        seen = np.ones((len(self.languages), len(self.index)))
        for r in rows:
            seen[self.languages.index(r["lang"]), self.index[r["gram"]]] += r["n"]
        self.log = np.log(seen / seen.sum(1, keepdims=True)) if rows else seen
        return self

    def guess(self, text: str | None) -> tuple[str, float]:
        clean = " ".join((text or "").split())
        if len(clean) < self.least or not self.languages:
            return "unknown", 0.0
        found = [(self.index[g], n) for g, n in self.grams(clean).items() if g in self.index]
        if not found:
            return "unknown", 0.0
        at, n = map(np.array, zip(*found))
        score = self.log[:, at] @ n
        p = np.exp(score - score.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())

    def detect(self, df: DataFrame, text: str) -> DataFrame:
        """df with language and probability."""
        at = df.columns.index(text)

        def run(batches):
            for b in batches:
                out = [self.guess(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([p for _, p in out], pa.float64())], names=[*b.schema.names, "language", "probability"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType())]))
