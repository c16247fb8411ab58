"""Personal data by weak supervision, in DataFrame functions only.

Regular expressions propose spans: the base ones of each kind, base matches that fail their check, and looser forms (spelled
addresses, phone numbers without a plus, cards with other separators, IPv6 and defanged addresses, secrets). Five labelers vote
on each (format check, gazetteer of prefixes and domains, words around it, characters next to it, shape).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind, and a logistic
span classifier is trained on the posteriors. Base spans stay; spans that the classifier accepts are added where they overlap
none of them.

All of a document's spans are found in its row, by array functions: nothing is shuffled but the counts of vote patterns, which
have at most a fixed number of rows (votes and bucketed features) and come to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, table

#: Kinds with base patterns, then those that the method adds.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
_AT = tuple(f"{b}{s}{w}" for b in "([{" for s in ("", " ") for w in ("at", "AT"))
_FOUR_DIGITS = "[0-9]{4}"
_SECRETS = ("token", "Token", "TOKEN", "secret", "Secret", "SECRET", "passw", "Passw", "PASSW", "api", "API", "Bearer")
#: Extractors: kind, whether base, pattern, and strings (or one pattern) of which a text with a match holds one. The base patterns
#: say the same as the plain ones in the contract, without backtracking into what they have read: a run of characters that a
#: plain pattern would try from each place is tried from its first, or from where the match before ended; cards with too few or
#: too many digits, which are dropped anyway, never match.
EXTRACTORS = {
    "email": ("email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    "ip": ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ()),
    "card": ("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", ()),
    "phone": ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
    "spelled_email": ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{] ?(?:at|AT) ?[)\]}] ?[A-Za-z0-9-]++(?: ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++", _AT),
    "worded_email": ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ (?:at|AT) [A-Za-z0-9-]++(?: (?:dot|DOT) [A-Za-z0-9-]++)++", (" dot ", " DOT ")),
    "loose_phone": ("phone", False, r"(?<![0-9.+()-])(?:\+?[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", _FOUR_DIGITS),
    "zero_phone": ("phone", False, r"(?<![0-9.+(-])00[1-9][0-9]{0,2}[\x20/-][\x20().0-9/-]{5,16}[0-9](?![0-9])", ("00",)),
    "parted_card": ("card", False, r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}(?![0-9])", _FOUR_DIGITS),
    "defanged_ip": ("ip", False, r"(?<![0-9])[0-9]{1,3}(?:[(\[]\.[)\]][0-9]{1,3}){3}(?![0-9])", ("[.]", "(.)")),
    "ipv6": ("ip", False, r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}))(?![A-Za-z0-9:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"),
    "secret": ("secret", False, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}", _SECRETS),
}
#: Characters of text around a span that labelers see.
AROUND = 40
_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|us|eu|ch|at|nl|co|me|biz"
_ABOUT = {
    "email": "mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|addr|host|server|node|ping|dirección|adresse",
    "card": "card|visa|master|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": r"phone|\btel|call|fax|mobile|cell|whatsapp|teléfono|téléphone|telefon|handy",
    "secret": r"token|secret|passw|api.?key|bearer|credential",
}
_OTHER = r"version|\bv[0-9]|isbn|order|invoice|\bid\b|serial|hash|sha|build|issue|sku"
#: Stands between the parts of a text; texts that hold it are cut in another way.
_MARK = ""


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check, read from the right."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check that a match of a kind's base pattern must pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    return F.length(_digits(value)).between(10, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(name: str, value: Column, before: Column, after: Column) -> list[Column]:
    kind, base, _, _ = EXTRACTORS[name]
    digits = _digits(value)
    n = F.length(digits)
    ok = passes(kind, value)
    form = _vote(ok, ~ok) if base or name == "parted_card" else F.lit(0)
    near = F.lower(F.concat_ws(" ", before, F.substring(after, 1, 15)))
    tight = before.rlike(r"[\p{L}0-9_=/#\"]$") | after.rlike(r"^[\p{L}0-9_\"]")
    beside = _vote(~tight, tight)
    if kind == "email":
        known = F.lower(value).rlike(rf"[. )\]}}](?:{_DOMAINS})$")
        shape = F.length(value).between(6, 80) & ~value.contains("..")
        bad = ~shape
    elif name == "ipv6":
        known = F.lower(value).rlike("^(?:2|3|f[cde])[0-9a-f]{3}:|^::1$")
        shape = F.length(value) >= 8
        bad = ~value.rlike("[0-9]") | ~shape
    elif kind == "ip":
        plain = F.regexp_replace(value, r"[\[\]()]", "")
        known = plain.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")
        shape = plain.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
        bad = ~shape
    elif kind == "card":
        known = digits.rlike("^(?:4|5[1-5]|2[2-7]|3[0-9]|6)")
        shape = value.rlike(r"^[0-9]{4}([\x20./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$") | value.rlike(r"^3[0-9]{3}([\x20./_-]?)[0-9]{6}\1[0-9]{5}$")
        bad = value.rlike(r"[\x20./_-]") & ~shape
    elif kind == "phone":
        known = n.between(10, 13)
        shape = value.rlike(r"^(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}$") | value.rlike("^00[1-9]")
        bad = ~n.between(7, 15)
    else:
        letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
        known = value.rlike("^(?:sk|pk|gh[pousr]|xox[abp]|AKIA|eyJ)[A-Za-z0-9_-]") | value.rlike("^[0-9a-f]{20,}$")
        shape = (n >= 3) & (letters >= 3)
        bad = (n == 0) | (letters == 0)
        beside = _vote(before.rlike(r"[=:]\s?[\"']?$|[\"']$|(?i:bearer) $"), before.rlike(r"[\p{L}.@/]$"))
    return [form, _vote(known, ~known), _vote(near.rlike(_ABOUT[kind]), near.rlike(_OTHER)), beside, _vote(shape, bad)]


LABELERS = 5
#: The format check's reliability to begin with (fails, none, passes): real data fail it once in a hundred, other strings pass it
#: once in ten (a random number's chance of a right check digit); it weighs as much as so many spans of each class.
CHECK, WEIGHT = {1: (0.01, 0.5, 0.99), 0: (0.9, 0.5, 0.1)}, 20.0


def parts_of(text: Column, pattern: str, needs: str | tuple[str, ...]) -> Column:
    """What lies between matches and the matches in turn; nothing in texts that hold the mark themselves or can't have a match. The
    pattern runs once over a text, and puts a mark around each match."""
    may = text.rlike(needs) if isinstance(needs, str) else None
    for x in () if isinstance(needs, str) else needs:
        may = text.contains(x) if may is None else may | text.contains(x)
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    use = ~text.contains(_MARK)
    return F.when(use if may is None else use & may, parts).otherwise(F.array().cast("array<string>"))


def matches_of(text: Column, pattern: str, parts: Column) -> Column:
    """Matches (m) with the text before (b) and after (a) each; from the parts, or, in texts that hold the mark, by the pattern."""
    none, marked = F.array().cast("array<string>"), text.contains(_MARK) & text.rlike(pattern)
    found = F.when(marked, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.filter(parts, lambda _, i: i % 2 == 1))
    between = F.when(marked, F.split(text, pattern, -1)).when(F.size(parts) > 1, F.filter(parts, lambda _, i: i % 2 == 0)).otherwise(none)
    zipped = F.arrays_zip(found.alias("m"), between.alias("b"), F.slice(between, 2, 1 << 30).alias("a"))
    return F.filter(zipped, lambda x: x["m"].isNotNull())


_SPAN = "struct<name:string,start:int,end:int,value:string,before:string,after:string>"


def candidates(docs: DataFrame, column: str = "candidates") -> DataFrame:
    """docs with an array of all matches (of _SPAN; in code points, end exclusive)."""
    text, names = F.coalesce("text", F.lit("")), list(EXTRACTORS)
    docs = docs.withColumns({f"__p{n}": parts_of(text, EXTRACTORS[n][2], EXTRACTORS[n][3]) for n in names})
    docs = docs.withColumns({f"__m{n}": matches_of(text, EXTRACTORS[n][2], F.col(f"__p{n}")) for n in names})

    def placed(name: str) -> Column:
        def add(done: Column, x: Column) -> Column:
            start = done["at"] + F.length(x["b"])
            end = start + F.length(x["m"])
            span = F.struct(F.lit(name), start, end, x["m"], F.right(x["b"], F.lit(AROUND)), F.left(x["a"], F.lit(AROUND))).cast(_SPAN)
            return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
        return F.aggregate(f"__m{name}", none, add, lambda x: x["spans"])

    return docs.withColumn(column, F.concat(*map(placed, names))).drop(*[f"__{c}{n}" for n in names for c in "pm"])


def _features(name: str, value: Column, before: Column, after: Column) -> list[Column]:
    """Votes (0, 1, 2), then the number of digits and of characters in buckets of 0 to 9."""
    size = lambda c, step: F.least(F.lit(9), F.floor(c / step)).cast("int")
    return [v + 1 for v in votes(name, value, before, after)] + [size(F.length(_digits(value)), 3), size(F.length(value), 8)]


NAMES = [f"f{i}" for i in range(LABELERS + 2)]


def _by_name(name: Column, make) -> Column:
    chosen = None
    for x in EXTRACTORS:
        chosen = F.when(name == x, make(x)) if chosen is None else chosen.when(name == x, make(x))
    return chosen


def pattern_counts(rows: DataFrame, column: str = "candidates") -> list[tuple[str, tuple[int, ...], int]]:
    """kind, features, number of candidates; as many as the features have values at most."""
    rows = rows.select(F.explode(column).alias("x")).select("x.*")
    each = {n: F.struct(*[f.alias(c) for c, f in zip(NAMES, _features(n, F.col("value"), F.col("before"), F.col("after")))]) for n in EXTRACTORS}
    rows = rows.select("name", _by_name(F.col("name"), each.get).alias("f")).select("name", "f.*")
    found = rows.groupBy("name", *NAMES).agg(F.count(F.lit(1)).alias("n")).orderBy("name", *NAMES).collect()
    return [(EXTRACTORS[r.name][0], tuple(r[c] for c in NAMES), r.n) for r in found]


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of each (kind, votes, count) by expectation-maximisation of a two-class model with independent labelers, whose vote
    distributions are estimated for each kind, begun from the format check where it votes, else from majority votes; and those
    distributions by kind (class, labeler, vote). The format check's has CHECK as its prior; where it doesn't vote it says nothing."""
    post, out = np.zeros(len(patterns)), {}
    for kind in dict.fromkeys(k for k, _, _ in patterns):
        at = [i for i, (k, _, _) in enumerate(patterns) if k == kind]
        v, n = np.array([patterns[i][1] for i in at]), np.array([patterns[i][2] for i in at], float)
        one = np.eye(3)[v]  # pattern, labeler, vote
        first = np.where(v[:, 0] != 1, v[:, 0] - 1, np.sign((v - 1).sum(axis=1)))
        p = 0.5 + 0.45 * first
        prior = np.ones((2, v.shape[1], 3))
        for y in (0, 1):
            prior[y, 0] = WEIGHT * np.array(CHECK[y])
        for _ in range(rounds):
            mass = np.stack([(1 - p) * n, p * n])
            votes_of = np.einsum("yi,ilx->ylx", mass, one) + prior
            votes_of[:, 0, 1] = 0
            share = votes_of / votes_of.sum(axis=2, keepdims=True)
            share[:, 0, 1] = 1
            odds = np.log((mass[1].sum() + 1) / (mass[0].sum() + 1)) + np.einsum("ilx,lx->i", one, np.log(share[1] / share[0]))
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        post[at], out[kind] = p, share
    return post, out


def train(patterns: list[tuple[str, tuple[int, ...], int]], steps: int = 300) -> dict[tuple, float]:
    """Weights of the span classifier by (kind, feature, value), and of (kind,) alone."""
    if not patterns:
        return {}
    post, _ = reliabilities([(k, f[:LABELERS], n) for k, f, n in patterns])
    keys = {k: i for i, k in enumerate(dict.fromkeys(x for k, f, _ in patterns for x in [(k,), *((k, i, v) for i, v in enumerate(f))]))}
    at = np.array([[keys[k,], *(keys[k, i, v] for i, v in enumerate(f))] for k, f, _ in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array([x for _, _, x in patterns], float)
    weight, speed = np.zeros(len(keys)), np.full(len(keys), 1e-8)
    for _ in range(steps):
        miss = (post - 1 / (1 + np.exp(-np.clip(weight[at].sum(axis=1), -30, 30)))) * n / n.sum()
        slope = np.bincount(at.reshape(-1), weights=np.repeat(miss, at.shape[1]), minlength=len(keys)) - 1e-3 * weight
        speed += slope**2
        weight += 0.5 * slope / np.sqrt(speed)
    return {k: float(weight[i]) for k, i in keys.items()}


def accepted(name: str, features: list[Column], weights: dict[tuple, float]) -> Column:
    kind = EXTRACTORS[name][0]
    z = F.lit(weights.get((kind,), 0.0))
    for i, f in enumerate(features):
        values = ", ".join(f"{weights.get((kind, i, x), 0.0)!r}D" for x in range(10 if i >= LABELERS else 3))
        z = z + F.element_at(F.expr(f"array({values})"), f + 1)
    return z > 0


_FOUND = "struct<start:int,more:boolean,back:int,place:int,end:int,clear:boolean>"


def spans(docs: DataFrame, weights: dict[tuple, float], candidates: str = "candidates", column: str = "spans") -> DataFrame:
    """docs with an array of the spans that stay, in the order of start, then of kind: start, more (no base span), place (of the kind
    in ALL, from 0 on), end.

    Added spans overlap no base span, and of those that overlap each other the first stays, judged against the last that did."""
    def judged(x: Column) -> Column:
        value, before, after = x["value"], x["before"], x["after"]
        base = _by_name(x["name"], lambda n: passes(EXTRACTORS[n][0], value) if EXTRACTORS[n][1] else F.lit(False))
        more = _by_name(x["name"], lambda n: accepted(n, _features(n, value, before, after), weights))
        place = _by_name(x["name"], lambda n: F.lit(ALL.index(EXTRACTORS[n][0])))
        return F.struct(x["start"].alias("start"), (~base).alias("more"), (-x["end"]).alias("back"), place.alias("place"), x["end"].alias("end"), (base | more).alias("clear")).cast(_FOUND)

    none = F.array().cast(f"array<{_FOUND}>")
    found = F.when(F.size(candidates) > 0, F.sort_array(F.filter(F.transform(candidates, judged), lambda x: x["clear"]))).otherwise(none)
    docs = docs.withColumn("__found", found)

    # from the end: does an added span end before the next base span begins?
    def ahead(done: Column, x: Column) -> Column:
        clear = ~x["more"] | (x["end"] <= done["next"])
        return F.struct(F.when(x["more"], done["next"]).otherwise(x["start"]).alias("next"), F.concat(done["spans"], F.array(x.withField("clear", clear))).alias("spans"))

    # from the start: does it begin after the last base span and the last added one that stays?
    def behind(done: Column, x: Column) -> Column:
        stays = x["clear"] & (~x["more"] | (x["start"] >= done["last"]))
        last = F.when(stays, F.greatest(x["end"], done["last"])).otherwise(done["last"])
        return F.struct(last.alias("last"), F.when(stays, F.concat(done["spans"], F.array(x))).otherwise(done["spans"]).alias("spans"))

    far, near = F.lit(2**31 - 1), F.lit(0)
    docs = docs.withColumn("__found", F.aggregate(F.reverse("__found"), F.struct(far.alias("next"), none.alias("spans")), ahead, lambda x: F.reverse(x["spans"])))
    docs = docs.withColumn("__found", F.aggregate("__found", F.struct(near.alias("last"), none.alias("spans")), behind, lambda x: x["spans"]))
    ordered = F.sort_array(F.transform("__found", lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["more"].alias("more"))))
    return docs.withColumn(column, ordered).drop("__found")


def _kind(place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ALL)), place + 1)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (array of kind:start:end), spans (all, joined by commas).

    A null text is empty and has no spans; a null doc_id stays; repeated rows get a row each; texts of any length are looked
    through whole; other columns are ignored; an empty table gives no rows. Spans are in the order of start, then of kind.
    """
    prepare(docs.sparkSession)
    rows = Scratch(docs.sparkSession).keep(candidates(docs.select(F.col("doc_id"), "text")).select("doc_id", "candidates"))
    rows = spans(rows, train(pattern_counts(rows)))
    base = F.filter("spans", lambda x: ~x["more"])
    named = lambda c: F.transform(c, lambda x: F.concat_ws(":", _kind(x["place"]), x["start"].cast("string"), x["end"].cast("string")))
    counts = [F.size(F.filter("base", lambda x: x["place"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    rows = rows.withColumn("base", base)
    return rows.select("doc_id", *counts, named(F.col("base")).alias("base"), F.array_join(named(F.col("spans")), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each of the spans that find() gives replaced by its kind in angle brackets (of spans that overlap, the first's kind
    stands for all); columns as they were. Nulls stay null; repeated rows, empty tables and long texts as in find()."""
    prepare(docs.sparkSession)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("text"))
    rows = Scratch(docs.sparkSession).keep(candidates(rows))  # found once, for the counts and for the spans
    rows = spans(rows, train(pattern_counts(rows)))

    def replace(done: Column, x: Column) -> Column:
        new = F.concat(F.substring(F.col("text"), done["at"] + 1, x["start"] - done["at"]), F.lit("<"), _kind(x["place"]), F.lit(">"))
        out = F.when(x["start"] >= done["at"], F.concat(done["parts"], F.array(new))).otherwise(done["parts"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), out.alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate("spans", start, replace, lambda x: F.concat(F.array_join(x["parts"], ""), F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))
    return rows.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in names.items()])


def op10_pii(spark, sf_dir):
    out = find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), "spans")
