"""URL filter: rules first, then logistic regression on hashed character n-grams (native).

A rule names a host, which stands for its subdomains too, and the beginning of a path;
of the rules that fit, the longest (host and path together) decides, and of equally
long ones the first in text order. URLs without a rule are judged by the model.

Features are the n-grams of ``^host$`` and of the path, hashed to ``buckets`` with a
salt for each part, each counted once per URL and scaled to unit length. The model is
trained by full gradient steps over a labelled URL table: each step is one aggregation by
bucket, and only the weights, whose number is fixed, come to the driver. The labelled
table may be large; ``train`` takes at most ``most_labelled`` of its rows, those with
the smallest hashes of their URLs, which are the same ones however it is partitioned.

Defined results: a null URL, or one without ``://``, has an empty host and path and
matches no rule; the model then sees the empty host. Repeated rows are judged alike. A
labelled table that is empty, or has one class, gives a model without weights, whose
bias says that class; without any label it allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemarks.session import written

BUCKETS = 4096
SIZES = (3, 4)
STEPS = 30
RATE = 8.0
DECAY = 1e-5
#: Labelled rows that the model is fitted on, at most.
MOST_LABELLED = 20_000
#: Characters of the path that n-grams are made of are all of them; the query and fragment are no part of it.
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the contract.
RULES = [
    Rule(BLOCK, "net"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL column."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(rules: list[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        own = (F.col(host) == rule.host) | F.col(host).endswith(f".{rule.host}")
        fits = own & F.col(path).startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def features(host: str = "host", path: str = "path", buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """Distinct buckets of the n-grams of host and path."""
    grams = []
    for salt, part in (("h", f"concat('^', {host}, '$')"), ("p", path)):
        for n in sizes:
            starts = f"if(length({part}) < {n}, cast(array() as array<int>), sequence(1, length({part}) - {n - 1}))"
            grams.append(f"transform({starts}, i -> cast(pmod(xxhash64('{salt}', substring({part}, i, {n})), {buckets}) as int))")
    return F.expr(f"array_distinct(concat({', '.join(grams)}))")


@dataclass(frozen=True)
class Model:
    bias: float
    weights: list[float]
    buckets: int = BUCKETS
    sizes: tuple[int, ...] = SIZES

    def score(self, column: str = "features") -> Column:
        """The log-odds of ``block`` for an array of buckets."""
        # The weights are one constant of fixed length, looked up by position.
        table = ",".join(f"{w:.9g}" for w in self.weights)
        total = (
            f"transform(array(cast(split('{table}', ',') as array<double>)), t -> "
            f"aggregate({column}, 0.0D, (a, i) -> a + t[i]))[0]"
        )
        return F.expr(f"{self.bias!r}D + ({total}) / sqrt(greatest(size({column}), 1))")


def train(
    labelled: DataFrame,
    url: str = "url",
    label: str = "label",
    buckets: int = BUCKETS,
    sizes: tuple[int, ...] = SIZES,
    steps: int = STEPS,
    rate: float = RATE,
    decay: float = DECAY,
    most_labelled: int = MOST_LABELLED,
) -> Model:
    """Fit to ``url, label`` (1 is block); rows with a null URL or label are left out."""
    rows = labelled.select(F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("double").alias("y")).filter("url IS NOT NULL AND y IS NOT NULL")
    rows = rows.distinct().orderBy(F.xxhash64("url"), "url", "y").limit(most_labelled)
    host, path = host_and_path("url")
    rows = rows.select("y", host.alias("host"), path.alias("path"))
    data = written(rows.select("y", features("host", "path", buckets, sizes).alias("features")), "url-features")
    n, positive = data.agg(F.count("*"), F.sum("y")).first()
    weights = [0.0] * buckets
    if not n or positive in (0, n):
        return Model(0.0 if not n else 10.0 if positive else -10.0, weights, buckets, sizes)
    bias = 0.0
    for _ in range(steps):
        own = Model(bias, weights, buckets, sizes)
        error = data.select((F.col("y") - 1 / (1 + F.exp(-own.score()))).alias("e"), "features")
        # Bucket -1 is the bias. The sums are one row per bucket, whatever the number of rows.
        step = error.select(
            F.explode(F.concat("features", F.array(F.lit(-1)))).alias("b"),
            "e", (F.col("e") / F.sqrt(F.greatest(F.size("features"), F.lit(1)))).alias("s"),
        )
        sums = step.groupBy("b").agg(F.sum(F.when(F.col("b") < 0, F.col("e")).otherwise(F.col("s"))).alias("g"))
        slope = {row["b"]: row["g"] / n for row in sums.collect()}
        bias += rate * slope.pop(-1, 0.0)
        weights = [w * (1 - decay) + rate * slope.get(i, 0.0) for i, w in enumerate(weights)]
    return Model(bias, weights, buckets, sizes)


def judge(pages: DataFrame, model: Model, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score`` of every URL."""
    host, path = host_and_path(f"`{url}`")
    split = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host, "path": path})
    split = split.withColumn("_llm_features", features("host", "path", model.buckets, model.sizes))
    rule, verdict = matched(rules)
    scored = split.withColumns({"rule": rule, "_llm_verdict": verdict, "score": model.score("_llm_features")})
    by_model = F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce("_llm_verdict", by_model)).drop("_llm_features", "_llm_verdict")


def labels_from_rules(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """A labelled URL table: the URLs that rules judge, 1 where the verdict is block."""
    host, path = host_and_path(f"`{url}`")
    _, verdict = matched(rules)
    own = pages.select(F.col(f"`{url}`").alias("url"), host.alias("host"), path.alias("path"))
    return own.select("url", verdict.alias("verdict")).filter("verdict IS NOT NULL").select("url", (F.col("verdict") == BLOCK).cast("int").alias("label"))
