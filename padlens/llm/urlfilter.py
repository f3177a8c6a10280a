"""URL verdicts: a list of rules, and association rules mined by FP-growth for what the list leaves open."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlens.llm.common import slices, staged

#: The list: verdict, host, path.
LIST = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled addresses that are mined, at most, and the least share of them that hold a rule and of those that bear its label.
SAMPLE, SUPPORT, CONFIDENCE = 200_000, 0.001, 0.8
#: Mined rules, of some 200 bytes each, that go to the tasks as an index.
RULES = 100_000

_PART = re.compile(r"[^\W_]+")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def listed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = LIST) -> DataFrame:
    """pages with host, path, and rule and verdict of the longest rule that fits (null: none)."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("listed", verdict)


def tokens_of(url: str | None) -> list[str]:
    """Distinct tokens of an address: parts of the host's labels, of path segments and of query keys, each marked by its
    place; numbers count as one token."""
    if not url or "://" not in url:
        return []
    scheme, rest = url.split("://", 1)
    rest = rest.split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    out = {"s:" + scheme.lower()}
    out |= {"h:" + p for p in _PART.findall(host.lower())}
    out |= {"p:" + ("0" if p.isdigit() else p) for p in _PART.findall(path.lower())}
    out |= {"q:" + p.partition("=")[0].lower() for p in query.split("&") if p}
    return sorted(out)


def token_classes(rows: DataFrame) -> DataFrame:
    """`token, name`: tokens that the same rows of rows(rid, tokens) hold share a name, that of the least of them.

    Row sets are equal if their sizes and two 64-bit hashes, each the exclusive-or over the rows' ids, are.
    """
    held = rows.select("rid", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token")
    sets = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("a"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("b"))
    names = sets.groupBy("n", "a", "b").agg(F.min("token").alias("name"))
    return sets.join(names, ["n", "a", "b"]).select("token", "name")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """`names array<string>, label, confidence, support` of the rules kept from labelled(tokens, label), and token_classes' table.

    FP-growth runs over each address's classes of tokens and its label, so that tokens that always come together (all
    parts of one path, say) are one item instead of all their combinations. A rule over names stands for one over any
    member of each. Rules need the confidence and support; one is dropped if a part of its names gives the same label
    no less confidently. Both tables stay in Spark.
    """
    spark = labelled.sparkSession
    rows = staged(labelled.select(F.monotonically_increasing_id().alias("rid"), "tokens", "label"), "labelled")
    classes = staged(token_classes(rows), "classes")
    names = rows.select("rid", F.explode("tokens").alias("token")).join(classes, "token").groupBy("rid").agg(F.collect_set("name").alias("names"))
    items = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.concat(F.lit("label:"), "label"))).alias("items")
    baskets = staged(rows.join(names, "rid", "left").select(items).repartition(spark.sparkContext.defaultParallelism), "baskets")  # FP-growth reads it several times
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith("label:"))
    found = staged(found.select(F.array_sort("antecedent").alias("names"), F.expr("substring(consequent[0], 7)").alias("label"), "confidence", "support"), "rules")
    # Every proper part of a rule's names, as the bits of a number; the equal rules among them are met by a join.
    bits = F.transform(F.sequence(F.lit(1).cast("long"), F.expr("shiftleft(1L, size(names)) - 2")), lambda m: F.filter("names", lambda _, i: F.getbit(m, i) == 1))
    parts = found.filter(F.size("names") > 1).select(F.col("names").alias("whole"), "label", "confidence", F.explode(bits).alias("names"))
    sure = found.select("names", "label", F.col("confidence").alias("sure"))
    weak = parts.join(sure, ["names", "label"]).filter("sure >= confidence").select(F.col("whole").alias("names"), "label").distinct()
    return staged(found.join(weak, ["names", "label"], "left_anti"), "kept"), classes


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[frozenset[str], str, float, float]]:
    """(names, label, confidence, support) of all mined_rules, for small tables."""
    kept, _ = mined_rules(labelled, support, confidence)
    return [(frozenset(r["names"]), r["label"], r["confidence"], r["support"]) for r in kept.collect()]


class RuleIndex:
    """Kept rules by an inverted index from class names, and the classes of their tokens."""

    def __init__(self, rules: list[tuple], classes: dict[str, str]) -> None:
        """rules: (names, label, confidence, support)."""
        self.rules, self.classes, self.holding = rules, classes, {}
        for i, (names, *_) in enumerate(rules):
            for n in names:
                self.holding.setdefault(n, []).append(i)

    def best(self, tokens: list[str]) -> tuple[str, float] | None:
        """Label and confidence of the most confident fitting rule, of these the best supported, then the one of the least tokens."""
        least: dict[str, str] = {}
        for t in tokens:  # sorted, so the first of a class is its least
            if t in self.classes:
                least.setdefault(self.classes[t], t)
        held: dict[int, int] = {}
        for n in least:
            for i in self.holding.get(n, ()):
                held[i] = held.get(i, 0) + 1
        fits = [self.rules[i] for i, k in held.items() if k == len(self.rules[i][0])]
        if not fits:
            return None
        top = max((r[2], r[3]) for r in fits)
        _, label = min((sorted(least[n] for n in r[0]), r[1]) for r in fits if (r[2], r[3]) == top)
        return label, top[0]


def _tokenise(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """url and a second column to url, tokens and that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="url"):
            tokens = pa.array([tokens_of(u) for u in batch.column("url").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("url"), tokens, batch.column(column)], ["url", "tokens", column])

    return run


def mined_verdicts(pages: DataFrame, kept: DataFrame, classes: DataFrame, most: int = RULES) -> DataFrame:
    """pages(page_id, url, host, path, rule, listed) with `verdict` and `confidence` where no rule of the list fits.

    Up to `most` rules go to the tasks as an index. More are joined: tokens to classes, classes to rules, and a rule fits
    an address that holds as many of its names as it has.
    """
    rows = kept.limit(most + 1).collect()
    if len(rows) > most:
        kept = staged(kept.withColumn("i", F.monotonically_increasing_id()), "numbered")
        index = kept.select("i", F.explode("names").alias("name"))
        urls = pages.filter("listed is null").select("url").distinct().withColumn("listed", F.lit(None).cast("string")).mapInArrow(_tokenise("listed"), "url string, tokens array<string>, listed string")
        held = urls.select("url", F.explode("tokens").alias("token")).join(classes, "token").groupBy("url", "name").agg(F.min("token").alias("token"))
        fits = held.join(index, "name").groupBy("url", "i").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("token")).alias("tokens"))  # a rule's names
        fits = fits.join(kept, "i").filter(F.col("n") == F.size("names"))
        order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "tokens", "label")
        best = fits.groupBy("url").agg(F.min(order).alias("b")).select("url", F.col("b.label").alias("mined"), (-F.col("b.c")).alias("sure"))
        out = pages.join(staged(best, "verdicts"), "url", "left")
        return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), F.when(F.col("listed").isNull(), F.col("sure")).alias("confidence"))
    names = kept.select(F.explode("names").alias("name")).distinct()
    # Each of these tokens is in at least the support's share of the labelled rows: the mean number of tokens over the support at most.
    tokens = {r["token"]: r["name"] for r in classes.join(names, "name", "left_semi").collect()}
    shared = pages.sparkSession.sparkContext.broadcast(RuleIndex([tuple(r) for r in rows], tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches, column="url"):
            found = [None if known else index.best(tokens_of(url)) for url, known in zip(batch.column("url").to_pylist(), batch.column("listed").to_pylist())]
            verdicts = [known or (f[0] if f else "allow") for known, f in zip(batch.column("listed").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array([f[1] if f else None for f in found], pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "confidence"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, confidence double")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = LIST, sample: int = SAMPLE, most: int = RULES) -> DataFrame:
    """`page_id, host, path, rule, verdict, confidence` for each row of pages(page_id, url).

    The list's longest fitting rule decides. The verdicts that it gives are the labels, as pages have no others: rules are
    mined from at most `sample` such addresses, those of least hash, and carry the list's judgement over to addresses
    with the same combinations of tokens. Of the mined rules whose tokens an address holds all, the most confident
    decides, then the best supported, then the least; `allow` if none fits. A null url or one without `://` has empty
    host and path, no tokens, and so is allowed. Urls of any length are taken whole, with all their tokens. Repeated rows come
    back each; no rows give no rows; other columns are ignored.

    Mining grows with the combinations of token classes that many addresses share: tokens of equal row sets cost
    nothing more, but d classes of which each one's rows hold the next one's still make 2**d combinations.
    """
    marked = listed(pages.select("page_id", "url"), rules)
    labelled = marked.filter("listed is not null").select("url", F.col("listed").alias("label"))
    labelled = labelled.orderBy(F.xxhash64("url"), "url").limit(sample).mapInArrow(_tokenise("label"), "url string, tokens array<string>, label string")
    return mined_verdicts(marked, *mined_rules(labelled), most)
