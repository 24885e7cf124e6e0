"""Personal data by weak supervision, with built-in functions only.

Base spans follow fixed patterns (`BASE_KINDS`). Beside them a wider net catches candidates that only look similar:
numbers with separators, addresses in other notation. Four labelers vote on every candidate and every base span: its
form, a gazetteer, words near it, and its length. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is in each family, with no labels. The posteriors then train the final classifier, a naive
Bayes model over features of the span alone. Candidates that it accepts and that touch no base span are added; base
spans always stay.

Only counts reach the driver: at most 4 families x 3^4 vote patterns, and the counts of the fixed feature values. The
text is read once per pass inside its row and is never shuffled.

Null texts count as empty and have no spans. Offsets are code points, ends exclusive. Patterns are written so that they
need time and stack in proportion to the text at most (no nested repetition, no restart inside a run).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK, FIELD, empty, let, match_spans
from .shared import held, settle

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = tuple(f"{k}_like" for k in BASE_KINDS)
JOINED = "\u0004"  # a separator inside a chain; taken out of the text first
SPAN = "struct<start:int,end:int,value:string>"
CANDIDATE = "struct<family:string,added:boolean,start:int,end:int,votes:string,features:array<string>>"

# What the gazetteers hold.
TOP_DOMAINS = "com org net edu gov info io de fr es it uk eu us ch at nl"
CARD_STARTS = "4|5[1-5]|2[2-7]|3[47]|6011|65"
PHONE_STARTS = r"\+?(?:1|33|34|39|4[0-9]|7|8[16]|9[0-5])\b|\([2-9][0-9]{2}\)"
RESERVED_IPS = r"0\.|127\.|10\.|192\.168\.|255\."
# Words that speak for or against a family when they stand near.
NEAR = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": "card|visa|master|credit|karte|tarjeta|carte",
    "phone": r"phone|\btel|\bcall|mobile|\bfax|telefon",
}
AGAINST = "version|release|section|page|isbn|figure|licen[cs]e|chapter|total"
NEAR_CHARS = 32

OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LOCAL, LABEL = r"A-Za-z0-9._%+" + JOINED + "-", "A-Za-z0-9-"


def prepared(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK + FIELD + JOINED, "\u0003" * 3)


def chained(text: Column, side: str, separators: str) -> Column:
    """Single separators between two characters of a class, marked: a chain is then one run of a class."""
    return F.regexp_replace(text, f"(?<=[{side}])[{separators}](?=[{side}])", JOINED)


def where(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(empty(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def emails(text: Column) -> Column:
    start = rf"(?:\G|(?<![{LOCAL}]))"
    domain = f"[{LABEL}]++{JOINED}[{LABEL}{JOINED}]+"
    return where(text.contains("@"), match_spans(chained(text, LABEL, "."), f"{start}[{LOCAL}]++@{domain}"))


def ip_like(text: Column) -> Column:
    return where(text.rlike(r"[0-9]\.[0-9]"), match_spans(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"))


def card_like(text: Column) -> Column:
    return where(text.rlike("[0-9][ -]?[0-9]"), match_spans(chained(text, "0-9", " -"), f"(?<![0-9{JOINED}])[0-9{JOINED}]{{13,}}+"))


def phones(text: Column) -> Column:
    return where(text.contains("+"), match_spans(text, r"\+[0-9][\x20().0-9-]+[0-9]"))


def number_groups(text: Column) -> Column:
    return where(text.rlike(r"[0-9]\)?[ .-][0-9]"), match_spans(text, r"(?<![0-9A-Za-z+.])(?:\([0-9]{1,4}\)|[0-9])[0-9 ()-]{5,}[0-9](?![0-9A-Za-z])"))


def written_emails(text: Column) -> Column:
    marked = r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}"
    return where(text.rlike(r"[(\[]at[)\]]"), match_spans(text, rf"(?<![A-Za-z0-9._%+-]){marked}"))


def valid_ip(value: Column) -> Column:
    return value.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")


def valid_card(value: Column) -> Column:
    return let(digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))


def valid_phone(value: Column) -> Column:
    return F.length(digits(value)).between(8, 15)


VALID = {"email": lambda value: F.lit(True), "ip": valid_ip, "card": valid_card, "phone": valid_phone}


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "1").when(no, "0").otherwise("?")


def judged(text: Column, spans: Column, family: str, form: Column | None = None) -> Column:
    """Spans of one family as candidates with votes and features. Base spans are those of valid form."""

    def one(s: Column) -> Column:
        value = F.regexp_replace(s["value"], JOINED, "-")
        near = F.lower(F.substring(text, F.greatest(s["start"] - NEAR_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR_CHARS))))
        n = F.length(digits(value))
        form_ok = VALID[family](s["value"]) if form is None else form
        known = {
            "email": F.lower(value).rlike(rf"(?:[.-]|dot[)\]] ?)(?:{TOP_DOMAINS.replace(' ', '|')})\z"),
            "ip": ~value.rlike(rf"\A(?:{RESERVED_IPS})"),
            "card": value.rlike(rf"\A(?:{CARD_STARTS})"),
            "phone": value.rlike(rf"\A(?:{PHONE_STARTS})"),
        }[family]
        right_length = {
            "email": F.length(value).between(6, 64), "ip": F.length(value).between(7, 15), "card": n.between(16, 19), "phone": n.between(10, 13),
        }[family]
        votes = F.concat(
            vote(form_ok, ~form_ok), vote(known, ~known), vote(near.rlike(NEAR[family]), near.rlike(AGAINST)), vote(right_length, ~right_length)
        )
        separators = F.regexp_replace(value, "[A-Za-z0-9]+", "")
        features = F.array(
            F.concat(F.lit("digits:"), F.least(n, F.lit(20)).cast("string")),
            F.concat(F.lit("length:"), F.least(F.length(value) / 4, F.lit(12)).cast("int").cast("string")),
            F.concat(F.lit("separators:"), F.least(F.length(separators), F.lit(6)).cast("string")),
            F.concat(F.lit("first:"), F.when(value.rlike(r"\A[0-9]"), F.substring(value, 1, 1)).when(value.rlike(r"\A\+"), "+").when(value.rlike(r"\A\("), "(").otherwise("a")),
            F.concat(F.lit("before:"), F.when(s["start"] == 0, "edge").when(near.rlike(r"\s\z"), "space").when(near.rlike(r"[\p{L}\p{N}]\z"), "word").otherwise("mark")),
        )
        return F.struct(
            F.lit(family).alias("family"), (~form_ok if form is None else F.lit(True)).alias("added"), s["start"].alias("start"), s["end"].alias("end"),
            votes.alias("votes"), features.alias("features"),
        )

    return F.transform(spans, one).cast(f"array<{CANDIDATE}>")


def candidates(text: Column) -> Column:
    """All candidates of a prepared text; those not `added` are the base spans, in the order of kinds and starts."""
    return F.concat(
        judged(text, emails(text), "email"), judged(text, ip_like(text), "ip"), judged(text, card_like(text), "card"), judged(text, phones(text), "phone"),
        judged(text, written_emails(text), "email", F.lit(False)), judged(text, number_groups(text), "phone", F.lit(False)),
    )


def estimate(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Posterior of a true span for every vote pattern of one family, by expectation-maximisation over their counts.

    Two classes, labelers independent within a class. It starts from the share of yes votes.
    """
    belief = {p: (p.count("1") + 0.5) / (p.count("1") + p.count("0") + 1) for p in patterns}
    total = sum(patterns.values())
    for _ in range(rounds):
        yes = sum(n * belief[p] for p, n in patterns.items())
        rates = []
        for i in range(len(next(iter(patterns)))):
            for symbol in "10?":
                hit = {p: n for p, n in patterns.items() if p[i] == symbol}
                a = (sum(n * belief[p] for p, n in hit.items()) + 1) / (yes + 3)
                b = (sum(n * (1 - belief[p]) for p, n in hit.items()) + 1) / (total - yes + 3)
                rates.append(((i, symbol), math.log(a) - math.log(b)))
        weight = dict(rates)
        prior = math.log((yes + 1) / (total - yes + 1))
        belief = {p: 1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(weight[i, s] for i, s in enumerate(p)))))) for p in patterns}
    return belief


def lookup(values: dict[str, float], key: Column) -> Column:
    """A bounded table of constants as a map."""
    if not values:
        return F.lit(None).cast("double")
    body = ",".join(f'"{k}":{v:.6f}' for k, v in sorted(values.items()))
    return F.get(F.map_values(F.map_filter(F.from_json(F.lit("{" + body + "}"), "map<string,double>"), lambda k, _: k == key)), F.lit(0))


def train(found: DataFrame) -> dict[str, float]:
    """Log odds of the final classifier: `family|feature` and `family|` for the prior. `found`: rows with `candidates`."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.family", "c.votes", "c.features")
    counts: dict[str, dict[str, int]] = {}
    for r in spans.groupBy("family", "votes").count().collect():
        counts.setdefault(r["family"], {})[r["votes"]] = r["count"]
    beliefs = {f"{family}|{votes}": p for family, patterns in counts.items() for votes, p in estimate(patterns).items()}
    if not beliefs:
        return {}
    believed = spans.groupBy("family", "votes", "features").count().withColumn("p", lookup(beliefs, F.concat_ws("|", "family", "votes")))
    features = believed.withColumn("feature", F.explode(F.concat(F.array(F.lit("")), "features"))).groupBy("family", "feature").agg(
        F.sum(F.col("count") * F.col("p")).alias("yes"), F.sum(F.col("count") * (1 - F.col("p"))).alias("no")
    )
    rows = features.collect()
    totals = {r["family"]: (r["yes"], r["no"]) for r in rows if r["feature"] == ""}
    weights = {}
    for r in rows:
        yes, no = totals[r["family"]]
        odds = math.log((r["yes"] + 1) / (r["no"] + 1))
        weights[f"{r['family']}|{r['feature']}"] = odds if r["feature"] == "" else odds - math.log((yes + 1) / (no + 1))
    return weights


def accepted(found: Column, weights: dict[str, float]) -> Column:
    """Base spans and the candidates that the classifier accepts, as array<struct<kind,start,end>> by kind and start."""

    def odds(c: Column) -> Column:
        names = F.concat(F.array(F.lit("")), c["features"])
        return F.aggregate(names, F.lit(0.0), lambda total, f: total + F.coalesce(lookup(weights, F.concat(c["family"], F.lit("|"), f)), F.lit(0.0)))

    def plain(c: Column, ending: str) -> Column:
        return F.struct(F.concat(c["family"], F.lit(ending)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))

    def choose(base: Column) -> Column:
        def free(c: Column) -> Column:
            return ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

        added = F.filter(found, lambda c: c["added"] & free(c) & (odds(c) >= 0))
        places = F.create_map(*[x for i, k in enumerate(BASE_KINDS) for x in (F.lit(k), F.lit(i))])
        ordered = F.array_sort(F.transform(added, lambda c: F.struct(F.get(F.array(places[c["family"]]), F.lit(0)).alias("place"), c["start"].alias("start"), c["end"].alias("end"), c["family"].alias("family"))))
        return F.concat(F.transform(base, lambda c: plain(c, "")), F.transform(ordered, lambda c: plain(c, "_like")))

    return let(F.filter(found, lambda c: ~c["added"]), choose)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and candidates of every row, kept in the shared folder (no text in it)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), prepared(F.col(text_column)).alias("text"))
    return settle(rows.select("doc_id", candidates(F.col("text")).alias("candidates")))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, spans: array<struct<kind,start,end>>. One row per row; other columns are left out."""
    found = scan(docs, id_column, text_column)
    return found.select("doc_id", accepted(F.col("candidates"), train(found)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap are masked as one, to the furthest
    end, with the kind of the longest (the first of equal ones)."""

    def rebuilt(ordered: Column) -> Column:
        nothing = F.lit(None).cast("string")
        state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("longest"), nothing.alias("kind"), F.array().cast("array<string>").alias("out"))
        name = lambda acc: F.concat(F.lit("["), F.upper(acc["kind"]), F.lit("]"))

        def put(acc: Column, s: Column) -> Column:
            size = s["end"] - s["start"]
            longer = size > acc["longest"]
            wider = F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"), F.greatest(acc["longest"], size).alias("longest"),
                F.when(longer, s["kind"]).otherwise(acc["kind"]).alias("kind"), acc["out"].alias("out"),
            )
            between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
            following = F.struct(
                s["end"].alias("at"), size.alias("longest"), s["kind"].alias("kind"),
                F.concat(acc["out"], F.array(F.coalesce(name(acc), F.lit("")), between)).alias("out"),
            )
            return F.when(s["start"] < acc["at"], wider).otherwise(following)

        return F.aggregate(
            ordered, state, put,
            lambda acc: F.concat(F.array_join(acc["out"], ""), F.coalesce(name(acc), F.lit("")), F.substring(text, acc["at"] + 1, F.length(text))),
        )

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, rebuilt))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns, with personal data masked in the text. Null texts stay null."""
    # Candidates and spans are worked out once each: the rows that hold them go on behind `held`.
    first = held(docs, candidates(prepared(F.col(text_column))).alias("candidates"))
    weights = train(settle(first.filter(F.size("candidates") > 0)))
    own = [F.col(c) for c in docs.columns]
    found = held(docs, F.struct(*own).alias("row"), candidates(prepared(F.col(text_column))).alias("found"))
    marked = held(found, "row", accepted(F.col("found"), weights).alias("spans"))
    text = F.col("row").getField(text_column)
    hidden = F.when(text.isNull(), F.lit(None)).when(F.size("spans") == 0, text).otherwise(masked(text, F.col("spans")))
    return marked.select(*(hidden.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base spans, the digest of their list, and all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
