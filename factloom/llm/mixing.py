"""Mixing sources to target weights with soft membership, with DataFrame functions only.

A multinomial classifier over hashed words, fitted on the labelled rows, gives each document the mean evidence of its
words for each domain; a scale, chosen so that on labelled rows it was not fitted on it is as sure as it is right, turns
that into posteriors. A text half in one domain and half in another is shared by both.
Rates r >= lowest then minimise sum over domains of (T - t)^2 / S, with T = sum of rate * tokens * posterior, t the
target and S the tokens there are. In the metric where a document counts as its tokens, the gradient for a document is
sum over domains of posterior * (T - t) / S and has a Lipschitz constant of 1 at most, since posteriors add up to 1:
projected gradient descent with step 1 needs no line search. A step takes one aggregate of a few numbers from all
documents, and a rate is a fold of the steps' residuals, so that nothing but those numbers reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, small, table

#: Bins of hashed words: the classifier is a table of so many rows and a number for each domain.
TERMS = 4_096
STEPS = 12
#: Scales that posteriors may have, and the labelled rows, one id in FOLD, that choose among them.
SCALES = tuple(2.0 ** (k / 2) for k in range(-2, 15))
FOLD = 5


def words_of(text: F.Column) -> F.Column:
    """Array of the text's words, runs of characters other than white space, and empty strings; it is never empty."""
    return F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ")


def term_of(word: str) -> F.Column:
    """Bin of a column of words, by first, middle and last character and length."""
    mixed = f"ascii({word}) * 7919L + ascii(right({word}, 1)) * 104729L + ascii(substr({word}, length({word}) div 2 + 1, 1)) * 1299709L + length({word}) * 15485863L"
    return F.expr(f"CAST(pmod({mixed}, {TERMS}L) AS INT)")


@dataclass(frozen=True)
class Classifier:
    """Domains with their log priors, the scale of the evidence, and a table (term, w): a log weight for each domain."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    scale: float
    weights: DataFrame


def domain_counts(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(domain, term, n): words of rows (doc_id, text) by the domain that named (doc_id, domain) has for the id."""
    words = rows.join(small(named), "doc_id").where(F.pmod("doc_id", F.lit(FOLD)) != 0).select("domain", F.explode(words_of(F.col("text"))).alias("w"))
    return words.where("w <> ''").groupBy("domain", term_of("w").alias("term")).agg(F.count("*").alias("n"))


def evidence(rows: DataFrame, keys: list[str], weights: DataFrame, n: int) -> DataFrame:
    """keys, n_tokens and e0, e1, ...: the mean log weight of each of the n domains over the words of rows (text, keys).

    One pass over the words; they are added up for each row before anything moves. weights has TERMS rows.
    """
    own = rows.withColumn("rid", F.monotonically_increasing_id())
    words = own.select("rid", *keys, F.explode(words_of(F.col("text"))).alias("w"))
    known = words.withColumn("term", F.when(F.col("w") != "", term_of("w")))
    met = known.join(F.broadcast(weights), "term", "left")
    sums = met.groupBy("rid", *keys).agg(F.count("term").alias("n_tokens"), *(F.coalesce(F.sum(F.col("w_of")[d]), F.lit(0.0)).alias(f"e{d}") for d in range(n)))
    size = F.greatest(F.col("n_tokens"), F.lit(1))
    return sums.select(*keys, "n_tokens", *((F.col(f"e{d}") / size).alias(f"e{d}") for d in range(n)))


def posteriors(priors: tuple[float, ...], scale: float) -> F.Column:
    """Array of posteriors over the domains, from e0, e1, ..."""
    raw = F.array(*(F.lit(p) + F.col(f"e{d}") * F.lit(scale) for d, p in enumerate(priors)))
    grown = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda a, y: a + y))


def fit(rows: DataFrame, labelled: DataFrame, scratch: Scratch) -> Classifier:
    """Learn from the rows (doc_id, text) that labelled (doc_id, domain) names; a few numbers reach the driver.

    A repeated id has its smallest domain. Ids divisible by FOLD are not fitted on: the scale is chosen on them, so that
    the mean of the largest posteriors is nearest to the share of right answers. Without such rows it is the middle one.
    Without labelled rows to fit on there is one domain, `all`.
    """
    spark = rows.sparkSession
    named = scratch.save(labelled.where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.min("domain").alias("domain")), "named")
    counts = scratch.save(domain_counts(rows, named), "counts")
    have = {r["domain"]: r["docs"] for r in named.groupBy("domain").agg(F.count("*").alias("docs")).collect()}  # a row a domain
    domains = tuple(sorted(r["domain"] for r in counts.select("domain").distinct().collect()))
    terms = spark.range(TERMS).select(F.col("id").cast("int").alias("term"))
    if not domains:
        return Classifier(("all",), (0.0,), 1.0, terms.withColumn("w_of", F.array(F.lit(0.0))))
    total = Window.partitionBy()
    columns = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(domains)]
    table_of = terms.join(counts.groupBy("term").agg(*columns), "term", "left").na.fill(0)  # TERMS rows
    weights = table_of.select("term", F.array(*(F.log((F.col(f"n{i}") + 1.0) / (F.sum(f"n{i}").over(total) + TERMS)) for i in range(len(domains)))).alias("w_of"))
    weights = scratch.save(weights, "weights")
    priors = tuple(math.log(have[d]) for d in domains)

    kept = rows.join(small(named), "doc_id").where(F.pmod("doc_id", F.lit(FOLD)) == 0).where(F.col("domain").isin(*domains))
    seen = evidence(kept, ["domain"], weights, len(domains))
    checks = []
    for k, scale in enumerate(SCALES):
        p = posteriors(priors, scale)
        right = F.element_at(F.array(*map(F.lit, domains)), F.array_position(p, F.array_max(p)).cast("int")) == F.col("domain")
        checks += [F.sum(F.array_max(p)).alias(f"sure{k}"), F.count_if(right).alias(f"right{k}")]
    got = seen.agg(F.count("*").alias("rows"), *checks).first()
    far = [abs(got[f"sure{k}"] / got["rows"] - (got[f"right{k}"] + 1) / (got["rows"] + 2)) if got["rows"] else abs(k - len(SCALES) // 2) for k in range(len(SCALES))]
    return Classifier(domains, priors, SCALES[far.index(min(far))], weights)


def residuals(soft: DataFrame, targets: list[float] | None, n: int, lowest: float = 0.0, steps: int = STEPS, smoothing: float = 0.7) -> list[list[float]]:
    """The steps' residuals (target - total) / tokens of each of the n domains, over the rows (n_tokens, p) of soft.

    targets: shares of all tokens; None: shares to the power of smoothing, in the smallest total that shrinks no domain.
    """
    totals = lambda rate: [float(x) for x in soft.agg(*(F.coalesce(F.sum(rate * F.col("n_tokens") * F.col("p")[d]), F.lit(0.0)) for d in range(n))).first()]
    have = totals(F.lit(1.0))
    if targets is None:
        bent = [x**smoothing for x in have]
        goal = [b * max((h / b for h, b in zip(have, bent, strict=True) if b), default=0.0) for b in bent]
    else:
        goal = [t * sum(have) for t in targets]
    now, out = [h * max(1.0, lowest) for h in have], []
    for _ in range(steps):
        out.append([(t - w) / h if h else 0.0 for t, w, h in zip(goal, now, have, strict=True)])
        now = totals(rate_of(out, lowest))
        if max((abs(t - w) for t, w in zip(goal, now, strict=True)), default=0.0) <= 1e-9 * sum(goal):
            break
    return out


def rate_of(steps: list[list[float]], lowest: float) -> F.Column:
    """Rate after the steps, projected onto lowest and more after each; from p alone."""
    rate = F.lit(max(1.0, lowest))
    for residual in steps:
        rate = F.greatest(F.lit(lowest), rate + sum((F.col("p")[d] * F.lit(x) for d, x in enumerate(residual)), F.lit(0.0)))
    return rate


def copies_of(id_col: str, rate: F.Column) -> F.Column:
    """Rate rounded up or down at random, by the hash of the id; a null id rounds as the text `null`."""
    u = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return F.floor(rate + u).cast("long")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the rows that labels names."""
    named = labels.select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("domain")).join(named, "doc_id", "left_semi")


def solve(docs: DataFrame, labelled: DataFrame, scratch: Scratch, targets: dict[str, float] | None, lowest: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[Classifier, list[list[float]], DataFrame]:
    """Classifier, residual steps, and the saved table (doc_id, mark, n_tokens, p); mark is a hash of the text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    model = fit(rows, labelled, scratch)
    seen = evidence(rows.withColumn("mark", F.xxhash64("text")), ["doc_id", "mark"], model.weights, len(model.domains))
    soft = scratch.save(seen.select("doc_id", "mark", "n_tokens", posteriors(model.priors, model.scale).alias("p")), "soft")
    goal = None if targets is None else [targets.get(d, 0.0) for d in model.domains]
    return model, residuals(soft, goal, len(model.domains), lowest), soft


def mix(docs: DataFrame, labelled: DataFrame, scratch: Scratch, targets: dict[str, float] | None, lowest: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), posterior (of it), rate and copies of every row of docs.

    targets: share of all tokens wanted of each domain; a domain that is not named gets none. A null or empty text has
    no tokens and the prior's posterior, a very long one is read whole; of equally likely domains the first by name
    counts. Ids may be null or repeated, each row has its own rate. Other columns are not read. Without rows the result
    is empty.
    """
    model, steps, soft = solve(docs, labelled, scratch, targets, lowest, id_col, text_col)
    top = F.array_max("p")
    best = F.array_position("p", top)
    rate = rate_of(steps, lowest)
    return soft.select("doc_id", "n_tokens", F.element_at(F.array(*map(F.lit, model.domains)), best.cast("int")).alias("domain"), F.round(top, 6).alias("posterior"), F.round(rate, 6).alias("rate"), copies_of("doc_id", rate).alias("copies"))


def resample(docs: DataFrame, labelled: DataFrame, scratch: Scratch, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, once each, and again as often as their copies over one say.

    targets None: shares of the domains, bent towards each other, in the smallest total that shrinks none. No rate is
    under 1: every row stays. Rows of one id and one text, null or not, have one rate and come again alike. A very long
    text is read whole. Other columns, whatever their names, are passed on. Without rows the result is empty.
    """
    _, steps, soft = solve(docs, labelled, scratch, targets, 1.0, id_col, text_col)
    rated = soft.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), copies_of("doc_id", rate_of(steps, 1.0)).alias("_copies"))
    more = scratch.save(rated.where("_copies > 1").distinct(), "more")  # only these rows are looked up again
    mark = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    again = docs.join(small(more), docs[id_col].cast("long").eqNullSafe(more["_id"]) & (mark == more["_mark"]))
    again = again.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.explode(F.sequence(F.lit(2).cast("long"), more["_copies"])))
    return docs.unionByName(again.select("row.*"))


#: Query op2: as many tokens of each language.
EQUAL = {"de": 0.25, "en": 0.25, "es": 0.25, "fr": 0.25}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix over table documents: as many tokens of each language, learned from the rows that table labels names."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mix(docs, labelled_languages(docs, labels), Scratch(spark, "op2"), EQUAL)


def oracle() -> str:
    """The same for the four languages of the tables: each step is a common table expression."""
    langs, n = sorted(EQUAL), range(len(EQUAL))
    mixed = "CAST(ascii(w) AS BIGINT) * 7919 + CAST(ascii(right(w, 1)) AS BIGINT) * 104729 + CAST(ascii(substr(w, length(w) // 2 + 1, 1)) AS BIGINT) * 1299709 + CAST(length(w) AS BIGINT) * 15485863"
    white = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    weights = ", ".join(f"ln((coalesce(sum(c.n) FILTER (WHERE lang = '{x}'), 0) + 1.0) / (sum(coalesce(sum(c.n) FILTER (WHERE lang = '{x}'), 0)) OVER () + {TERMS})) AS w{i}" for i, x in enumerate(langs))
    scores = lambda scale: [f"(p{i} + e{i} * {scale})" for i in n]
    sure = lambda scale: f"1 / ({' + '.join(f'exp({x} - greatest({", ".join(scores(scale))}))' for x in scores(scale))})"
    right = lambda scale: f"(CASE greatest({', '.join(scores(scale))}) {' '.join(f'WHEN {x} THEN {chr(39)}{lang}{chr(39)}' for x, lang in zip(scores(scale), langs, strict=True))} END = lang)"
    far = " UNION ALL ".join(f"SELECT {k} AS k, CAST({scale} AS DOUBLE) AS scale, abs(sum({sure(scale)}) / count(*) - (count(*) FILTER (WHERE {right(scale)}) + 1.0) / (count(*) + 2)) AS far FROM held" for k, scale in enumerate(SCALES))
    chosen = [f"(p{i} + e{i} * scale)" for i in n]
    grown = [f"exp({x} - greatest({', '.join(chosen)}))" for x in chosen]
    steps = ""
    for k in range(STEPS):
        rate = "1.0" if k == 0 else "rate"
        source = "soft" if k == 0 else f"r{k}"
        sums = ", ".join(f"sum({rate} * n_tokens * p[{d + 1}]) AS t{d}" for d in n)
        move = " + ".join(f"p[{d + 1}] * (h.g{d} - t{d}) / h.h{d}" for d in n)
        steps += f",\nt{k + 1} AS MATERIALIZED (SELECT {sums} FROM {source}),\nr{k + 1} AS MATERIALIZED (SELECT doc_id, n_tokens, p, greatest(0.0, {rate} + ({move})) AS rate FROM {source}, t{k + 1}, have h)"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, string_split(translate(coalesce(text, ''), {white}, '     '), ' ') AS ws FROM documents),
t AS MATERIALIZED (
  SELECT rid, doc_id, lang, CASE WHEN w <> '' THEN ({mixed}) % {TERMS} END AS term FROM (SELECT rid, doc_id, lang, unnest(ws) AS w FROM d)),
l AS MATERIALIZED (SELECT DISTINCT doc_id FROM labels),
c AS (SELECT lang, term, count(*) AS n FROM t WHERE term IS NOT NULL AND doc_id % {FOLD} <> 0 AND doc_id IN (FROM l) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, {weights} FROM range({TERMS}) r(term) LEFT JOIN c USING (term) GROUP BY term),
prior AS (SELECT {", ".join(f"ln(count(DISTINCT doc_id) FILTER (WHERE lang = '{x}')) AS p{i}" for i, x in enumerate(langs))} FROM d WHERE doc_id IN (FROM l)),
e AS MATERIALIZED (
  SELECT rid, t.doc_id, any_value(lang) AS lang, count(term) AS n_tokens, {", ".join(f"coalesce(sum(w{i}), 0) / greatest(count(term), 1) AS e{i}" for i in n)}, {", ".join(f"any_value(p{i}) AS p{i}" for i in n)}
  FROM t LEFT JOIN f USING (term), prior GROUP BY rid, t.doc_id),
held AS (SELECT * FROM e WHERE doc_id % {FOLD} = 0 AND doc_id IN (FROM l)),
scale AS MATERIALIZED (SELECT scale FROM ({far}) ORDER BY far, k LIMIT 1),
soft AS MATERIALIZED (SELECT doc_id, n_tokens, [{", ".join(f"{g} / ({' + '.join(grown)})" for g in grown)}] AS p FROM e, scale),
have AS MATERIALIZED (SELECT {", ".join(f"sum(n_tokens * p[{d + 1}]) AS h{d}, sum(n_tokens) * 0.25 AS g{d}" for d in n)} FROM soft){steps}
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, {langs}[list_position(p, list_max(p))] AS domain, round(list_max(p), 6) AS posterior, round(rate, 6) AS rate,
  CAST(floor(rate + CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0) AS BIGINT) AS copies
FROM r{STEPS}"""
