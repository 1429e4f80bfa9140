r"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the matches of strict patterns (the base: email, IPv4 address,
card number passing Luhn, international phone number; those that fail their
check are dropped) and of looser ones (spelled-out email addresses, national
phone numbers, shorter card numbers, IPv6 addresses in full or with ``::``).  Labelers vote on every
candidate, or abstain:

* pattern: the strict pattern matched;
* form: check digits, area code, top-level domain;
* gazetteer: known domains, issuer digits, country codes;
* context: words before it that announce such data, or speak against it;
* edges: white space or punctuation around it.

Expectation-maximisation estimates each labeler's reliability for true and
false candidates and the share of true ones per kind and pattern, from the
counts of vote patterns over the whole corpus.  A labeler with nothing to go by
for a kind of candidate (the gazetteer knows country codes, and national numbers
have none) is not asked there and says nothing either way.  A logistic span classifier is then trained on the
posterior labels, with features of the candidate: the votes given, its length
and what separates its parts (an abstention is no feature); it decides on the looser candidates.  Base spans
always stay; a looser span that touches one goes.

Vote patterns and features have fixed, small sets of values, so what reaches
the driver is at most ``MAX_PATTERNS`` counted rows, whatever the corpus; each
is counted with map-side combining.  Positions are running sums of the lengths
between and of the matches; only matches, not texts, are shuffled.

Defined results: null and empty texts have no spans; rows that share id and
text get the same result; null ids are kept; an empty table gives no rows;
other columns are not read.  Patterns start only where a run of their
characters starts and use no nested repetition, so very long texts and runs
cost linear time and constant stack.  Overlaps are found by running maxima in
the order of the spans, and a text is redacted from segments of ``SEGMENT``
characters, so many spans in one text cost linear time too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

KINDS = ("email", "ip", "card", "phone")
_L = "[A-Za-z0-9._%+-]"
_D, _DD = "[A-Za-z0-9-]", "[A-Za-z0-9.-]"
_H = "[0-9A-Fa-f]{1,4}"
_HS = rf"{_H}(?::{_H}){{0,6}}+"
STRICT = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@(?={_D}++\.{_D}){_DD}+?(?=\.\.|\.(?!{_DD})|(?!{_DD}))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{_L}){_L}{{1,64}}+ ?(?:\(at\)|\[at\]|\{{at\}}) ?{_D}{{1,63}}+"
             rf"(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}|\.) ?{_D}{{2,63}}+){{1,8}}",
    "ip": rf"(?<![0-9A-Fa-f:])(?:{_H}:){{7}}{_H}(?![0-9A-Fa-f:])"
          rf"|(?<![0-9A-Za-z])(?<![0-9A-Fa-f:]:)(?:{_HS}::(?:{_HS})?+|(?<!:)::{_HS})(?![0-9A-Za-z]|:[0-9A-Fa-f:]|\.[0-9])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}(?![ -]?[0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![ .-]?[0-9])",
}
# cheap tests a text must pass before a pattern is tried
NEEDS = {("email", True): r"@", ("ip", True): r"[0-9]\.[0-9]", ("card", True): r"[0-9]", ("phone", True): r"\+[0-9]",
         ("email", False): r"[(\[{]at[)\]}]", ("ip", False): r"[0-9A-Fa-f]:[0-9A-Fa-f]|::", ("card", False): r"[0-9]",
         ("phone", False): r"[0-9][-. ][0-9]"}
FOR = {"email": r"(?i)\b(e-?mail|mail|contact|write|reach|address)\b", "ip": r"(?i)\b(ip|ipv6|host|server|address)\b",
       "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|pay)\b",
       "phone": r"(?i)\b(call|phone|tel|telephone|fax|mobile|cell|reach|contact|dial)\b"}
AGAINST = r"(?i)\b(version|isbn|issn|section|build|order|invoice|serial|model|figure|table|page|rev)\b"
DOMAINS = "(?i)[. ]?(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca)$"
COUNTRIES = r"^\+(1|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CONTEXT = 40
VOTES = ("form", "gazetteer", "context", "edges")      # -1, 0 (abstains), 1; the strict pattern groups them
NOT_ASKED = 2
SEPARATORS = ("-", ".", " ", "[(\\[{]")              # the first one found is the candidate's
MAX_PATTERNS = 4 * 2 * 3**3 * 4 * 3 * (1 + len(SEPARATORS))
SEGMENT = 256
ROUNDS = 30


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.reverse(_digits(m))
    value = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0),
                        lambda s, i: s + F.when(i % 2 == 0, twice(i)).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: Column, m: Column) -> Column:
    """The base checks of a strict match."""
    part = lambda x: F.regexp_replace(x, "^0+", "")
    ip = F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3)
                  & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    return (F.when(kind == "ip", ip).when(kind == "card", luhn(m))
            .when(kind == "phone", F.length(_digits(m)).between(8, 15)).otherwise(F.lit(True)))


def _match(name: str, kind: str, strict: bool):
    """The struct of the i-th match m, with what stands around it."""
    def one(m, i):
        gap = F.get(F.col("g_" + name), i)
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(strict).alias("strict"), i.alias("i"), F.length(gap).alias("gap"),
            m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("before"),
            F.substring(F.get(F.col("g_" + name), i + 1), 1, 1).alias("after"))
    return one


def candidates(texts: DataFrame) -> DataFrame:
    """(doc, tag, kind, strict, start, end, votes ..., bucket) of all candidates
    in ``texts`` (doc, tag, text); positions in code points, end exclusive."""
    # one scan: per pattern the gaps and matches of the texts that have what it needs
    cols, all_matches = [], []
    none = F.array().cast("array<struct<kind:string,strict:boolean,i:int,gap:int,m:string,before:string,after:string>>")
    for strict, patterns in ((True, STRICT), (False, LOOSE)):
        for kind, p in patterns.items():
            name = f"{kind}_{strict}"
            has = F.col("text").rlike(NEEDS[kind, strict])
            cols += [F.when(has, F.split("text", p, -1)).alias("g_" + name),
                     F.when(has, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("m_" + name)]

            all_matches.append(F.coalesce(F.transform("m_" + name, _match(name, kind, strict)), none))
    rows = texts.select("doc", "tag", *cols).select("doc", "tag", F.explode(F.concat(*all_matches)).alias("x"))
    rows = rows.select("doc", "tag", "x.*")
    rows = rows.distinct()
    upto = Window.partitionBy("doc", "tag", "kind", "strict").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    kind, m, strict = F.col("kind"), F.col("m"), F.col("strict")
    rows = rows.where(~strict | _valid(kind, m))
    vote = lambda yes: F.when(yes, 1).otherwise(-1)
    area = F.regexp_extract(m, r"([0-9]{3})\)?[-. ]{0,2}([0-9])[0-9]{2}[-. ][0-9]{4}$", 0)
    form = (F.when((kind == "email"), vote(F.regexp_replace(m, r"[)\]} ]", "").rlike(r"[A-Za-z]{2,}$")))
            .when(kind == "card", vote(luhn(m)))
            .when((kind == "phone") & ~strict, vote(area.rlike(r"^[2-9]") & area.rlike(r"[-. ]+[2-9][0-9]{2}[-. ][0-9]{4}$")))
            .when((kind == "ip") & m.contains("::"), vote((F.size(F.array_remove(F.split(m, ":"), "")) <= 7) & m.rlike("[0-9]")))
            .otherwise(F.lit(1)))
    gazetteer = (F.when((kind == "email") & m.rlike(DOMAINS), 1).when((kind == "card") & m.rlike("^[3-6]"), 1)
                 .when((kind == "phone") & m.rlike(COUNTRIES), 1)
                 .when((kind == "ip") & ~m.rlike(r"^0\b"), 1)
                 .when((kind == "phone") & ~strict, NOT_ASKED).otherwise(F.lit(0)))
    announced = F.lit(False)
    for k in KINDS:
        announced = announced | ((kind == k) & F.col("before").rlike(FOR[k]))
    context = F.when(announced, 1).when(F.col("before").rlike(AGAINST), -1).otherwise(0)
    edge = lambda c: (c == "") | c.rlike(r"[\s\p{Punct}]")
    edges = vote(edge(F.right("before", F.lit(1))) & edge(F.coalesce("after", F.lit(""))))
    bucket = F.when(size < 12, 0).when(size < 20, 1).otherwise(2)
    sep = F.coalesce(*[F.when(m.rlike(p if len(p) > 1 else f"[{p}]"), i)
                       for i, p in reversed(list(enumerate(SEPARATORS, 1)))], F.lit(0))
    return rows.select("doc", "tag", "kind", "strict", F.col("start").cast("long").alias("start"),
                       F.col("end").cast("long").alias("end"), form.cast("int").alias("form"),
                       gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"),
                       edges.cast("int").alias("edges"), bucket.cast("int").alias("bucket"),
                       sep.cast("int").alias("sep"))


def reliabilities(counts: list[tuple]) -> tuple[dict, dict, list[float]]:
    """EM over counted vote patterns (kind, strict, votes, n).

    Returns P(vote | true or false) by (labeler, truth, vote), the share of
    true candidates by (kind, strict) and each pattern's posterior."""
    heard = [sum(x for x in v if x != NOT_ASKED) for _, _, v, _ in counts]
    post = [0.95 if strict else (1 + max(-2, min(2, s))) / 4 * 0.9 + 0.05 if s > -1 else 0.05
            for (_, strict, _, _), s in zip(counts, heard)]
    rates: dict = {}
    share: dict = {}
    for _ in range(ROUNDS):
        num: dict = {}
        tot: dict = {}
        groups: dict = {}
        for (kind, strict, v, n), p in zip(counts, post):
            g = groups.setdefault((kind, strict), [1.0, 2.0])
            g[0] += n * p
            g[1] += n
            votes = (1 if strict else 0, *v)
            for j, x in enumerate(votes):
                if x == NOT_ASKED:
                    continue
                for z, w in ((1, n * p), (0, n * (1 - p))):
                    num[j, z, x] = num.get((j, z, x), 0.0) + w
                    tot[j, z] = tot.get((j, z), 0.0) + w
        # one pseudo-count per value
        rates = {(j, z, x): (num.get((j, z, x), 0.0) + 1) / (tot[j, z] + 3) for j, z in tot for x in (-1, 0, 1)}
        share = {k: a / b for k, (a, b) in groups.items()}
        new = []
        for kind, strict, v, _ in counts:
            logit = math.log(share[kind, strict] / max(1e-9, 1 - share[kind, strict]))
            for j, x in enumerate((1 if strict else 0, *v)):
                if x != NOT_ASKED:
                    logit += math.log(rates[j, 1, x] / rates[j, 0, x])
            new.append(1 / (1 + math.exp(-max(-30, min(30, logit)))))
        if max((abs(a - b) for a, b in zip(new, post)), default=0) < 1e-9:
            break
        post = new
    return rates, share, post


def features(kind: str, strict: bool, votes, bucket: int, sep: int) -> list[str]:
    """Names of the active features of a candidate."""
    return ["bias", f"kind={kind}", f"strict={strict}", f"bucket={bucket}", f"sep={sep}",
            *(f"{n}={x}" for n, x in zip(VOTES, votes) if x in (-1, 1))]


def train_classifier(rows: list[tuple], rounds: int = 400, ridge: float = 1e-3) -> dict[str, float]:
    """Logistic regression on counted rows (features, soft label, n), by
    gradient descent with a fixed number of rounds."""
    names = sorted({f for fs, _, _ in rows for f in fs})
    w = dict.fromkeys(names, 0.0)
    # every feature combination counts by the root of its size, so rare forms are learnt too
    rows = [(fs, y, math.sqrt(n)) for fs, y, n in rows]
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        grad = dict.fromkeys(names, 0.0)
        for fs, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[f] for f in fs)))))
            for f in fs:
                grad[f] += n * (y - p) / total
        for f in names:
            w[f] += 2.0 * (grad[f] - ridge * w[f])
    return w


def classifier(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, trained on the whole corpus's counts."""
    groups = found.groupBy("kind", "strict", *VOTES, "bucket", "sep").agg(F.count("*").alias("n")).collect()
    assert len(groups) <= MAX_PATTERNS
    groups.sort(key=lambda r: tuple(r))
    patterns: dict = {}
    for r in groups:
        k = (r.kind, r.strict, tuple(r[v] for v in VOTES))
        patterns[k] = patterns.get(k, 0) + r.n
    counts = [(*k, n) for k, n in patterns.items()]
    post = dict(zip(patterns, reliabilities(counts)[2]))
    return train_classifier([
        (features(r.kind, r.strict, [r[v] for v in VOTES], r.bucket, r.sep),
         post[r.kind, r.strict, tuple(r[v] for v in VOTES)], r.n) for r in groups])


def accepted(weights: dict[str, float]) -> Column:
    """Whether the classifier takes a candidate."""
    score = F.lit(weights.get("bias", 0.0))
    for name, w in sorted(weights.items()):
        if name != "bias":
            col, value = name.split("=")
            score = score + F.when(F.col(col).cast("string") == value.lower(), w).otherwise(0.0)
    return score > 0


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag, k, start, end, base): the accepted spans."""
    texts = C.ordered_texts(docs, id_col, text_col).select("doc", "tag", "text")
    found = C.settle(candidates(texts), "private")
    weights = classifier(found)
    k = F.coalesce(*[F.when(F.col("kind") == name, i) for i, name in enumerate(KINDS)])
    rows = found.where(F.col("strict") | accepted(weights)).select(
        "doc", "tag", k.alias("k"), "start", "end", F.col("strict").alias("base"))
    text = Window.partitionBy("doc", "tag").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(F.col("base"), F.col("end"))).over(text.orderBy("start"))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(text.orderBy(F.col("start").desc()))
    rows = rows.withColumn("before", before).withColumn("after", after)
    touched = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(
        F.col("after") < F.col("end"), F.lit(False))
    return rows.where(F.col("base") | ~touched).drop("before", "after")


def _listed(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(
        ":", F.get(names, x.k), x.start.cast("string"), x.end.cast("string"))), ",")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each
    row; the counts and the hash are those of base spans."""
    keys = C.ordered_texts(docs, id_col, text_col).select("doc", "tag", "doc_id")
    found = spans(docs, id_col, text_col).groupBy("doc", "tag").agg(
        F.array_sort(F.collect_list(F.struct("k", "start", "end", "base"))).alias("all"))
    rows = keys.join(found, ["doc", "tag"], "left")
    every = F.coalesce("all", F.array().cast("array<struct<k:int,start:bigint,end:bigint,base:boolean>>"))
    rows = rows.select("doc_id", every.alias("all")).select(
        "doc_id", "all", F.filter("all", lambda x: x.base).alias("base"))
    count = lambda i: F.size(F.filter("base", lambda x: x.k == i)).cast("long")
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    k1, k2, found, segments = C.free_names(docs, "k1", "k2", "found", "segments")
    # what earlier spans of the text have covered up to each one
    upto = Window.partitionBy("doc", "tag").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans(docs, id_col, text_col).withColumn("reach", F.coalesce(F.max("end").over(upto), F.lit(0)))
    rows = rows.groupBy(F.col("doc").alias(k1), F.col("tag").alias(k2)).agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "k", "reach"))).alias(found))
    keyed = docs.withColumn(k1, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))).withColumn(
        k2, F.pmod(F.xxhash64(text_col), F.lit(1 << 31)))
    rows = keyed.join(rows, [k1, k2], "left").withColumn(segments, F.when(F.col(found).isNotNull(), F.regexp_extract_all(
        text_col, F.lit("(?s).{1,%d}" % SEGMENT), F.lit(0))))

    def piece(a, b):
        """The text from a to b, from the segments that hold it."""
        s, i, j = F.col(segments), F.floor(a / SEGMENT).cast("int"), F.floor(b / SEGMENT).cast("int")
        part = lambda x, start, size: F.substring(F.coalesce(F.get(s, x), F.lit("")), start.cast("int"), size.cast("int"))
        return F.when(i == j, part(i, a % SEGMENT + 1, b - a)).otherwise(F.concat(
            part(i, a % SEGMENT + 1, F.lit(SEGMENT)), F.array_join(F.slice(s, i + 2, j - i - 1), ""),
            part(j, F.lit(1), b % SEGMENT)))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    out = F.transform(found, lambda x: F.when(x.start >= x.reach, F.concat(
        piece(x.reach, x.start), F.get(names, x.k))).otherwise(F.lit("")))
    end = F.array_max(F.transform(found, lambda x: x.end))
    done = F.concat(F.array_join(out, ""), piece(end, F.greatest(end, F.length(text_col).cast("bigint"))))
    return rows.withColumn(text_col, F.when(F.col(found).isNull(), F.col(text_col)).otherwise(done)).select(*docs.columns)
