"""Personal data by weak supervision, with DataFrame functions only.

Base patterns report by their form.  Looser patterns propose further spans.
Four labelers vote on every candidate (1, 0 or -1): its checks by rule, a
gazetteer, the words around it, and its shape.  Expectation-maximisation over
the counts of vote patterns, at most a few thousand whatever the input, estimates how
reliable each labeler is; the posteriors then train a logistic classifier over
votes, shape and kind, which decides on the further spans.  Base spans always stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm.shared import keep

# The base kinds, in the order that they are listed in, and then the kinds of further candidates.
BASE = ("email", "ip", "card", "phone")
MORE = ("phone_local", "email_spoken", "iban", "ssn")
KINDS = BASE + MORE

# Patterns.  Possessive groups and look-behinds give the leftmost greedy matches of the plain
# patterns in linear time: no match can start inside a run that failed from its start.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators that has 13 to 19 digits as a whole
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "phone_local": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "email_spoken": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[(\[]at[)\]] ?[A-Za-z0-9-]{2,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z]{2,24}){1,4}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# Gazetteers.
DOMAINS = "com org net edu gov int io de fr es uk it nl at ch eu us ca jp cn in br ru pl se no fi dk be pt info example".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 380 420 421".split()
BANKS = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
# Words before a span that speak for or against a kind.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|tarjeta|karte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "iban": r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
CUES |= {"phone_local": CUES["phone"], "email_spoken": CUES["email"]}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|item|section|chapter|figure|sku|ref|serial)\b"
#: Code points before a span that the context labeler reads.
CONTEXT = 40
#: Kinds whose check many other texts of the form fail; for the rest, passing it says nothing, and the labeler abstains.
CHECKED = ("ip", "card", "phone", "iban")
LABELERS = ("rule", "gazetteer", "context", "shape")
ROUNDS, STEPS, RATE = 25, 200, 1.0


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once: inside a lambda, an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks(items: Column, body) -> Column:
    """Array of ``body`` of each stretch of the array ``items``, a column or a variable, cut into as many stretches as a stretch is long; none for an empty one."""
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    return _let(width, lambda w: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, w), lambda at: body(F.slice(items, at + 1, w)))).otherwise(F.array()))


def walk(items: Column, state: Column, out_type: str, step) -> Column:
    """Array of outputs: ``step`` takes a state and an item and gives the next state and an output.

    An array that grows by one is copied each time, so outputs are gathered in blocks: n items cost n^1.5 copies of a reference at most.
    """
    empty, wide = (F.expr(f"cast(array() as {'array<' * k}{out_type}{'>' * k})") for k in (1, 2))

    def inner(acc: Column, x: Column) -> Column:
        now, out = step(acc.state, x)
        return F.struct(now.alias("state"), F.concat(acc.out, F.array(out)).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc.state.alias("state"), empty.alias("out")), inner)
        return _let(done, lambda d: F.struct(d.state.alias("state"), F.concat(acc.out, F.array(d.out)).alias("out")))

    return _let(items, lambda xs: F.flatten(F.aggregate(blocks(xs, lambda b: b), F.struct(state.alias("state"), wide.alias("out")), outer, lambda acc: acc.out)))


MATCH = "struct<start: int, end: int, value: string, before: string, after: string>"


def in_text(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after) of the matches of ``pattern``; code points, end exclusive.

    The parts between the matches and the matches themselves give the places, what stands
    before a match (``CONTEXT`` characters) and the one character after it.
    """
    found = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def put(state: Column, x: Column) -> tuple[Column, Column]:
        start = state.at + F.length(x.part)
        end = start + F.length(x.value)
        before = F.right(F.concat(state.tail, x.part), F.lit(CONTEXT))
        out = F.struct(start.alias("start"), end.alias("end"), x.value.alias("value"), before.alias("before"), x.after.alias("after"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x.value), F.lit(CONTEXT)).alias("tail")), out

    def places(f: Column) -> Column:
        n = F.size(f["values"])
        after = F.zip_with(F.slice(f.parts, 2, n), F.slice(f["values"], 2, n), lambda p, v: F.coalesce(F.nullif(F.left(p, F.lit(1)), F.lit("")), F.left(v, F.lit(1)), F.lit("")))
        named = F.zip_with(F.slice(f.parts, 1, n), f["values"], lambda p, v: F.struct(p.alias("part"), v.alias("value")))
        items = F.zip_with(named, after, lambda x, a: F.struct(x.part.alias("part"), x.value.alias("value"), a.alias("after")))
        return walk(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), MATCH, put)

    return _let(found, places)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits hold: its first four characters go last, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def octets(value: Column) -> Column:
    """Four numbers of at most 255; leading zeros don't count."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def holds(kind: str, value: Column) -> Column:
    """The check by rule: for a base kind, what its definition asks of a match."""
    n = F.length(digits(value))
    return {
        "email": F.lit(True), "ip": octets(value), "card": luhn(digits(value)), "phone": n.between(9, 15), "phone_local": n == 10,
        "email_spoken": value.rlike(r"(?:dot|\.)"), "iban": mod97(value), "ssn": ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    }[kind]


def listed(kind: str, value: Column) -> Column:
    """The gazetteer: known endings of domains, calling codes, issuers, countries with IBANs."""
    last = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    known = {
        "email": last.isin(DOMAINS), "email_spoken": last.isin(DOMAINS), "card": digits(value).rlike(ISSUERS), "iban": F.substring(value, 1, 2).isin(BANKS),
        "phone": reduce(lambda a, k: a | F.substring(digits(value), 1, k).isin(CALLING), (2, 3), F.substring(digits(value), 1, 1).isin(CALLING)),
        "phone_local": digits(value).rlike("^[2-9][0-9]{2}[2-9]"), "ip": ~value.rlike(r"^(?:0|[0-9]\.[0-9]\.[0-9]\.[0-9]$)"), "ssn": ~value.rlike("^(?:123-45-6789|078-05-1120|219-09-9999)$"),
    }
    return F.when(known[kind], 1).otherwise(-1)


def shaped(kind: str, value: Column) -> Column:
    """Regular grouping speaks for a span, mixed separators against it."""
    n = value
    return {
        "card": F.when(n.rlike("^[0-9]{13,19}$|^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}$|^[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5}$"), 1).otherwise(-1),
        "phone": F.when(n.rlike(r"[.( -]{3}|\.\."), -1).otherwise(1), "phone_local": F.when(n.rlike(r"^\([0-9]{3}\) |^[0-9]{3}([.-])[0-9]{3}\1"), 1).otherwise(-1),
        "email": F.when(n.rlike(r"^[.%+-]|\.\.|[.-]@"), -1).otherwise(1), "email_spoken": F.when(n.rlike(r"dot"), 1).otherwise(0),
        "iban": F.when(n.rlike("^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$|^[A-Z0-9]+$"), 1).otherwise(-1),
        "ip": F.when(n.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1), "ssn": F.lit(1),
    }[kind]


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, base, votes, bare): every candidate span of a text, kind by kind.

    ``base`` marks the base kinds' matches that hold; ``bare`` those that touch no letter or digit.
    """
    has = {
        "email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){12}"), "phone": F.contains(text, F.lit("+")),
        "phone_local": text.rlike("[0-9]{3}[.-][0-9]{4}"), "email_spoken": text.rlike(r"[(\[]at[)\]]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"),
    }
    kind_type = "struct<kind: string, start: int, end: int, base: boolean, votes: array<int>, bare: boolean>"

    def described(kind: str) -> Column:
        def describe(x: Column) -> Column:
            before = x.before
            ok = holds(kind, x.value)
            votes = F.array(
                F.when(ok, int(kind in CHECKED)).otherwise(-1), listed(kind, x.value), F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0), shaped(kind, x.value)
            )
            bare = ~before.rlike("[A-Za-z0-9]$") & ~x.after.rlike("[A-Za-z0-9]")
            return F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), (ok if kind in BASE else F.lit(False)).alias("base"), votes.alias("votes"), bare.alias("bare"))

        return F.when(has[kind], F.transform(in_text(text, PATTERNS[kind]), describe)).otherwise(F.expr(f"cast(array() as array<{kind_type}>)"))

    return F.concat(*map(described, KINDS))


@dataclass(frozen=True)
class Weights:
    """The final classifier: a bias for each kind, and weights of the votes and of ``bare``."""

    bias: dict[str, float]
    votes: tuple[float, ...]
    bare: float

    def score(self, x: Column) -> Column:
        """Probability that a candidate is personal data."""
        bias = reduce(lambda a, k: F.when(x.kind == k, self.bias[k]).otherwise(a), KINDS, F.lit(0.0))
        z = reduce(lambda a, l: a + self.votes[l] * F.get(x.votes, F.lit(l)), range(len(LABELERS)), bias + self.bare * x.bare.cast("int"))
        return 1 / (1 + F.exp(-z))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def train(marks: DataFrame, rounds: int = ROUNDS, steps: int = STEPS) -> Weights:
    """Reliabilities by EM and the classifier's weights, from a table with a column ``found`` of candidates.

    All candidates count, as counts of equal patterns: kinds x 3^labelers x 2 rows
    at most, so one row holds them.  One row of weights reaches the driver.
    """
    patterns = marks.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.bare").agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("kind", "votes", "bare", "n"))).alias("p"))
    # at first, the share of the votes that speak for a span; little for one that fails its check
    share = lambda x: (F.aggregate(x.votes, F.lit(0), lambda a, v: a + v) + len(LABELERS)) / (2.0 * len(LABELERS))
    start = F.transform("p", lambda x: F.when(F.get(x.votes, F.lit(0)) < 0, 0.1).otherwise(0.1 + 0.8 * share(x)))

    def mass(q: Column, weigh) -> Column:
        return _total(F.zip_with("p", q, weigh))

    def vote(x: Column, k: int, v: int) -> Column:
        return (F.get(x.votes, F.lit(k)) == v).cast("double")

    def em(q: Column, _: Column) -> Column:
        def masses(k: int, v: int) -> tuple[Column, Column]:
            return mass(q, lambda x, y: x.n * y * vote(x, k, v)), mass(q, lambda x, y: x.n * (1 - y) * vote(x, k, v))

        each = [masses(k, v) for k in range(len(LABELERS)) for v in (-1, 0, 1)]
        all_yes, all_no = mass(q, lambda x, y: x.n * y), mass(q, lambda x, y: x.n * (1 - y))
        # log-likelihood ratio of each vote, smoothed by one count; the last place holds the prior's
        table = F.array(*(F.log((a + 1) / (all_yes + 3)) - F.log((b + 1) / (all_no + 3)) for a, b in each), F.log((all_yes + 1) / (all_no + 1)))

        def posterior(t: Column) -> Column:
            def of(x: Column) -> Column:
                z = reduce(lambda a, k: a + F.get(t, 3 * k + 1 + F.get(x.votes, F.lit(k))), range(len(LABELERS)), F.get(t, F.lit(3 * len(LABELERS))))
                return 1 / (1 + F.exp(-z))

            return F.transform("p", of)

        return _let(table, posterior)

    believed = one.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, em).alias("q"))
    width = len(KINDS) + len(LABELERS) + 1

    def features(x: Column) -> list[Column]:
        return [(x.kind == k).cast("double") for k in KINDS] + [F.get(x.votes, F.lit(k)).cast("double") for k in range(len(LABELERS))] + [x.bare.cast("double")]

    rows = F.zip_with("p", "q", lambda x, y: F.struct(F.array(*features(x)).alias("f"), x.n.alias("n"), y.alias("y")))
    ready = believed.select(rows.alias("r"), F.greatest(mass(F.col("q"), lambda x, y: x.n), F.lit(1.0)).alias("all"))
    dot = lambda a, b: _total(F.zip_with(a, b, lambda u, v: u * v))
    zero = F.array_repeat(F.lit(0.0), width)

    def descend(w: Column, _: Column) -> Column:
        slope = F.aggregate("r", zero, lambda g, x: _let(x.n * (1 / (1 + F.exp(-dot(x.f, w))) - x.y), lambda e: F.zip_with(g, x.f, lambda a, f: a + e * f)))
        return F.zip_with(w, slope, lambda a, g: a - RATE * (g / F.col("all") + 0.0001 * a))

    got = ready.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, descend).alias("w")).first().w
    n = len(KINDS)
    return Weights(dict(zip(KINDS, got[:n], strict=True)), tuple(got[n : n + len(LABELERS)]), got[-1])


def spans(found: Column, weights: Weights, least: float = 0.5) -> Column:
    """The spans to report: all base ones, and further ones that the classifier accepts and that overlap no base span.

    One pass over all ends of further spans and starts of base ones in order: a further span is free if no
    base span that starts before its end goes beyond its start.
    """
    base = F.filter(found, lambda x: x.base)
    more = F.filter(found, lambda x: x.kind.isin(*MORE) & (weights.score(x) >= least))
    start = F.transform(base, lambda x: F.struct(x.start.alias("at"), F.lit(1).alias("side"), x.start.alias("start"), x.end.alias("end"), F.lit(-1).alias("place")))
    stop = F.transform(more, lambda x, k: F.struct(x.end.alias("at"), F.lit(0).alias("side"), x.start.alias("start"), x.end.alias("end"), k.alias("place")))

    def look(furthest: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(furthest, F.when(x.side == 1, x.end).otherwise(0)), F.when((x.side == 0) & (furthest <= x.start), x.place)

    def chosen(both: Column) -> Column:
        free = F.array_sort(F.filter(walk(F.array_sort(F.concat(both.start, both.stop)), F.lit(0), "int", look), lambda k: k.isNotNull()))
        return F.concat(both.base, F.transform(free, lambda k: F.get(both.more, k)))

    parts = F.struct(base.alias("base"), more.alias("more"), start.alias("start"), stop.alias("stop"))
    return _let(parts, lambda p: F.when((F.size(p.base) == 0) | (F.size(p.more) == 0), F.concat(p.base, p.more)).otherwise(chosen(p)))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, start, end, base, votes, bare), base kinds first, each kind by start.

    Trained on all of ``docs``.  A null or empty text has no span; repeated rows
    give equal rows; a null doc_id stays null; a very long text is searched whole.  Without candidates nothing is learnt
    and nothing found; an empty table gives no rows; other columns are not read, so their names don't matter.
    """
    marks = keep(docs.select("doc_id", candidates(_text()).alias("found")), "pii")
    return marks.select("doc_id", spans(F.col("found"), train(marks)).alias("found"))


def covered(text: Column, found: Column) -> Column:
    """``text`` with each span of ``found`` replaced by its kind in brackets.

    Spans are cut in order, in blocks: a substring counts characters from its start, so each is taken from the stretch of text of its block.
    """
    order = F.array_sort(F.transform(found, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))))
    cut_type = "struct<since: int, begin: int, end: int, kind: string>"

    def cut(at: Column, x: Column) -> tuple[Column, Column]:
        own = F.struct(at.alias("since"), F.greatest(x.start, at).alias("begin"), x.end.alias("end"), x.kind.alias("kind"))
        return F.greatest(x.end, at), F.when(x.end > at, own)

    def written(block: Column) -> Column:
        first, last = F.get(block, F.lit(0)), F.element_at(block, -1)
        stretch = F.struct(F.substring(text, first.since + 1, last.begin - first.since).alias("text"), first.since.alias("at"))
        gap = lambda r, c: F.substring(r.text, c.since - r.at + 1, c.begin - c.since)
        return _let(stretch, lambda r: F.array_join(F.transform(block, lambda c: F.concat(gap(r, c), F.lit("["), F.upper(c.kind), F.lit("]"))), ""))

    def whole(cuts: Column) -> Column:
        return F.concat(F.array_join(blocks(cuts, written), ""), F.substr(text, F.element_at(cuts, -1).end + 1))

    cuts = F.filter(walk(order, F.lit(0), cut_type, cut), lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, _let(cuts, whole)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each reported span replaced by its kind in brackets, and n_chars counted anew.

    Overlapping spans are replaced by order of their starts; what an earlier one
    covered is not replaced again.  A null text stays null, an empty one empty; repeated rows give equal rows; an empty
    table stays empty; a very long text is covered whole; other columns stay as they are and may have any name that doesn't begin with "__".  The documents are written once with their candidates, and read for training and for the result.
    """
    marked = keep(docs.withColumn("__found", candidates(_text())), "pii")
    shown = marked.withColumn("__spans", spans(F.col("__found"), train(marked.select(F.col("__found").alias("found")))))
    # under names of their own: inside a lambda, "text" would mean a new column of that name in the same select
    shown = shown.withColumn("__clean", covered(F.col("text"), F.col("__spans")))
    changed = {"text": F.col("__clean"), "n_chars": F.length("__clean").cast("long")}
    return shown.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))
