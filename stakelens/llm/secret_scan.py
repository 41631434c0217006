"""Secret scans: three fixed patterns, and a battery of randomness tests for what they miss.

Candidates are runs of at least twenty key characters with letters and digits among them. The encoding is inferred
from the characters (hex, base 32, letters of one case and digits, letters and digits, base 64). The tests look at each
candidate's

- runs: its changes between digits, capitals, small letters and signs;
- frequencies: how evenly it uses the alphabet;
- serial dependence: which letters follow each other.

Each is weighed as a likelihood ratio, chance in the encoding against ordinary tokens (words, joined by case, signs or
numbers), and conditional on the one before: class after class, letter in its class, letter after letter. So their product
is the ratio of the whole token, and one over it is a p-value of "ordinary": a ratio has mean one under the model it
is taken against, so it exceeds x with a probability of 1 / x at most, at any length. A candidate is a secret if that
combined p-value rejects "ordinary" and neither chi-squared nor the serial correlation speaks against chance. The
rejection is controlled for false discoveries (Benjamini-Hochberg) among the candidates of the same encoding and length
class, so that many short candidates do not hide or carry the long ones. P-values are rounded up to a tenth of a decade;
counts of the rounded values are all that is gathered from the corpus, and they add in any order.

Everything runs inside Spark's own expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fresh, let

# The base patterns and their least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole run, if it has 18 characters or more
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")

RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {  # by inferred encoding, the narrowest that fits; letters of one case are read as small ones
    "hex": ("^[0-9a-fA-F]+$", DIGITS + "abcdef"),
    "base32": ("^(?:[A-Z2-7]+|[a-z2-7]+)$", LETTERS + "234567"),
    "base36": ("^(?:[A-Z0-9]+|[a-z0-9]+)$", LETTERS + DIGITS),
    "alnum": ("^[A-Za-z0-9]+$", LETTERS.upper() + LETTERS + DIGITS),
    "base64": ("", LETTERS.upper() + LETTERS + DIGITS + "+/"),
}
ONE_CASE = ("hex", "base32", "base36")
# Ordinary tokens: how often a class follows another (start, small, capital, digit, sign), with and without case ...
STEPS = {
    " ": {"a": 0.6, "A": 0.3, "0": 0.09, "+": 0.01}, "a": {"a": 0.84, "A": 0.05, "0": 0.05, "+": 0.06},
    "A": {"a": 0.43, "A": 0.45, "0": 0.06, "+": 0.06}, "0": {"a": 0.08, "A": 0.08, "0": 0.7, "+": 0.14},
    "+": {"a": 0.5, "A": 0.2, "0": 0.25, "+": 0.05},
}
STEPS_ONE_CASE = {" ": {"a": 0.8, "0": 0.2}, "a": {"a": 0.92, "0": 0.08}, "0": {"a": 0.25, "0": 0.75}}
# ... and how often a letter begins or follows another: a row for the beginning, then by the letter before; -4 log2 of the
# share, rounded down, in base 36. English text, blended with plain letter shares (20 %) and an even share (20 %).
FOLLOWS = (
    "fniicjmkgqohjfgjrffejooonr mkghjnkpirodfemkrdfclmponr dpjlcopogdqdnlgmrhhkdqqqhr eqmncnpfirhfmlanrikckqqrpr "
    "fomi7nppcrqkolgorjhjgqqqor hphghinolrqdkdlkpceeonoinr eqmmfgpparrhnlanreiigqqror jpnn8omjerqhmfjnrgbjgoqrqq "
    "bqnn6opperqmnldorjkimqqrpr jmhjhkkpmrpfh9elrieeomqnqm iqkn5oppkrkmomcnrljkeqqrpr hqlk6nmofrqgoiklrkekkphrqr "
    "fpnjacppdrqgolfmrlghiqqrkr bjnm7oppgrqlklderlijkqqrpr epgdclfoirnlokdmrlgcknqror kjifimopkrojhajhrbiehnlqqr "
    "cqmmbnpnhrqeolehrdjekoprjr mpnnjoppmrrjoklorikk3qqrqr epll9nipfrnmkfenrgggkpprkr jqkn7onkfrolnlijrlfbiqpqlr "
    "eqlmbnpbdrqknlhmrehigqoqjr kllldknpjrqdgdlhrbfenqqpqr 8qnn6opofrqmnlkorllloqpqqr cqnkenpdarqkoheordikoqoqqr "
    "gpanempofrqkmmlerlj8oqqmor lolmemoohrrkjhj9rkcaoplrpq jqnn4opodrrjlkhorllkoqqroq"
).split()
LENGTH_CLASSES = (32, 48, 96)
FALSE_DISCOVERIES = 0.01
AGAINST_CHANCE = 0.001
MOST_TENTHS = 400


def _class(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c == " " else "+"


def evidence(encoding: str) -> list[int]:
    """Hundredths of decades by which each character, after each (or none), speaks for chance against ordinary tokens.

    Rows by the character before, none first, one after another.
    """
    alphabet = ALPHABETS[encoding][1]
    steps = STEPS_ONE_CASE if encoding in ONE_CASE else STEPS

    def share(before: str, c: str) -> float:
        row = FOLLOWS[LETTERS.find(before.lower()) + 1] if before != " " else FOLLOWS[0]
        return 2 ** (-int(row[LETTERS.index(c.lower())], 36) / 4) if c.isalpha() else 1.0

    out = []
    for before in " " + alphabet:
        within = {k: sum(share(before, c) for c in alphabet if _class(c) == k) for k in set(map(_class, alphabet))}
        classes = sum(steps[_class(before)][k] for k in within)
        for c in alphabet:
            ordinary = steps[_class(before)][_class(c)] / classes * share(before, c) / within[_class(c)]
            out.append(math.floor(-100 * math.log10(len(alphabet) * ordinary)))
    return out


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _running_sums(values: Column) -> Column:
    """Inclusive prefix sums of an int array of n, in n ** 1.5 steps: sums of blocks, and of the rest in a block."""

    def sums(s: Column) -> Column:
        v, block = s["v"], s["block"]
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int")), lambda b: _total(
            F.slice(v, (b * block + 1).cast("int"), block)))
        return let(blocks, lambda bs: let(
            F.transform(bs, lambda x, b: _total(F.slice(bs, F.lit(1), b))),
            lambda before: F.transform(v, lambda x, i: F.get(before, (i / block).cast("int")) + _total(
                F.slice(v, (i - i % block + 1).cast("int"), i % block + 1)))))

    sized = F.struct(values.alias("v"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int")).alias("block"))
    return let(sized, lambda s: F.when(F.size(s["v"]) > 0, sums(s)).otherwise(s["v"]))


def _cut(text: Column, pattern: str, group: int) -> Column:
    """Struct of the matches, their wanted groups, and the ``gaps`` before, between and after them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), part.alias("part"))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, left to right: array of start, end (code points, end exclusive), text and the wanted group.

    What lies between the matches gives their places, so the cost is linear in the text.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,text:string,part:string>>")

    def placed(t: Column) -> Column:
        return let(_cut(t, pattern, group), lambda m: let(
            _running_sums(F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["whole"])), m["whole"],
                                     lambda gap, x: F.length(gap) + F.length(x))),
            lambda ends: F.transform(m["whole"], lambda x, i: F.struct(
                (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"),
                x.alias("text"), F.get(m["part"], i).alias("part")))))

    return let(text, lambda t: F.when(t.rlike(pattern), placed(t)).otherwise(nothing))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end) that the fixed patterns find, in order."""
    assigned = F.filter(located(text, ASSIGN, 1), lambda m: F.length(m["part"]) >= LEAST_ASSIGNED)
    return F.sort_array(F.concat(
        _spans(assigned, "assign"), _spans(located(text, ACCESS), "access"), _spans(located(text, HEX), "hex")))


def _upper_tail(z: Column) -> Column:
    """Of the standard normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    fixed = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    series = reduce(lambda acc, c: (acc + c) * t, reversed(fixed), F.lit(0.0))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tests(token: Column, alphabet: Column, table: Column) -> Column:
    """Struct of ``decades`` (hundredths for chance against ordinary) and the two p-values of chance."""
    n = F.length(token)
    k = F.length(alphabet)
    places = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c))
    decades = let(places, lambda at: _total(F.transform(at, lambda x, i: F.get(
        table, F.coalesce(F.get(at, i - 1), F.lit(0)) * k + x - 1))))

    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow(
        (n - F.length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0)))
    free = k - 1
    chi = F.greatest(k / n * squares - n, F.lit(0.0))
    z_even = (F.cbrt(chi / free) - (1 - 2 / (9.0 * free))) / F.sqrt(2 / (9.0 * free))

    codes = F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda acc, x: acc + x) / n
    off = let(F.struct(codes.alias("c"), mean.alias("m")), lambda s: F.transform(s["c"], lambda x: x - s["m"]))
    z_serial = let(off, lambda d: let(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x), lambda var: F.when(
        var > 0, (F.aggregate(F.transform(d, lambda x, i: x * F.coalesce(F.get(d, i + 1), F.lit(0.0))), F.lit(0.0),
                              lambda acc, x: acc + x) / var + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(99.0))))
    return F.struct(decades.alias("decades"), _upper_tail(z_even).alias("even"),
                    (2 * _upper_tail(F.abs(z_serial))).alias("serial"))


def _read(core: Column) -> Column:
    """A candidate in its inferred encoding: token, alphabet, table of evidence, stratum."""

    def by_name(e: Column, choices: dict[str, Column]) -> Column:
        return reduce(lambda other, name: F.when(e == name, choices[name]).otherwise(other), ALPHABETS, choices["base64"])

    encoding = reduce(lambda other, name: F.when(core.rlike(ALPHABETS[name][0]), F.lit(name)).otherwise(other),
                      list(ALPHABETS)[-2::-1], F.lit("base64"))
    length = reduce(lambda c, at: c + (F.length(core) >= at).cast("int"), LENGTH_CLASSES, F.lit(0))
    standard = F.replace(F.replace(core, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    tokens = {name: F.lower(core) for name in ONE_CASE} | {"alnum": core, "base64": standard}
    alphabets = {name: F.lit(characters) for name, (_, characters) in ALPHABETS.items()}
    tables = {name: F.split(F.lit(",".join(map(str, evidence(name)))), ",").cast("array<int>") for name in ALPHABETS}
    return let(encoding, lambda e: F.struct(
        by_name(e, tokens).alias("token"), by_name(e, alphabets).alias("alphabet"), by_name(e, tables).alias("table"),
        F.concat(e, F.lit("/"), length.cast("string")).alias("stratum")))


def _scored(found: Column) -> Column:
    """Candidates among matches of RUN: array of start, end, text, stratum, tenths (rounded p-value), by_chance."""
    mixed = F.filter(found, lambda m: m["text"].rlike("[0-9]") & m["text"].rlike("[A-Za-z]"))

    def of(m: Column) -> Column:
        return let(F.rtrim(m["text"], F.lit("=")), lambda core: let(_read(core), lambda r: let(
            _tests(r["token"], r["alphabet"], r["table"]), lambda p: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), r["stratum"].alias("stratum"),
                F.least(F.lit(MOST_TENTHS), F.greatest(F.lit(0), F.floor(p["decades"] / 10))).cast("int").alias("tenths"),
                ((p["even"] >= AGAINST_CHANCE) & (p["serial"] >= AGAINST_CHANCE)).alias("by_chance"),
            ))))

    return F.transform(mixed, of)


def candidates(text: Column, base: Column) -> Column:
    """Scored candidates that no base span covers wholly."""
    return let(F.struct(_scored(located(text, RUN)).alias("s"), base.alias("b")), lambda x: F.filter(
        x["s"], lambda c: ~F.exists(x["b"], lambda b: (b["start"] <= c["start"]) & (
            c["start"] + F.length(F.rtrim(c["text"], F.lit("="))) <= b["end"]))))


def cutoffs(scored: DataFrame, column: str) -> dict[str, int]:
    """By stratum, the least rounded score that counts as a discovery.

    ``scored`` has an array of candidates per row. At most one number for each of 20 strata comes to the driver.
    """
    one = scored.select(F.explode(F.col(column)).alias("c")).select("c.stratum", "c.tenths")
    sums = one.groupBy("stratum", "tenths").agg(F.count("*").alias("n"))
    # At most MOST_TENTHS rows a stratum: candidates with at least this score, of all of the stratum.
    table = sums.groupBy("stratum").agg(F.collect_list(F.struct("tenths", "n")).alias("t"), F.sum("n").alias("all"))
    at_least = F.transform("t", lambda x: F.struct(x["tenths"].alias("tenths"), F.aggregate(
        F.col("t"), F.lit(0).cast("long"), lambda acc, y: acc + F.when(y["tenths"] >= x["tenths"], y["n"]).otherwise(0)
    ).alias("n")))
    found = table.select("stratum", F.array_min(F.transform(F.filter(at_least, lambda x: (
        F.pow(F.lit(10.0), x["tenths"] / -10.0) <= FALSE_DISCOVERIES * x["n"] / F.col("all")
    )), lambda x: x["tenths"])).alias("least"))
    return {r["stratum"]: r["least"] for r in found.filter("least is not null").collect()}


def _discovered(c: Column, least: dict[str, int]) -> Column:
    """Whether a scored candidate is a secret."""
    by_stratum = reduce(lambda other, s: F.when(c["stratum"] == s, F.lit(least[s])).otherwise(other), sorted(least),
                        F.lit(MOST_TENTHS + 1))
    return c["by_chance"] & (c["tenths"] >= by_stratum)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, durable: Callable[..., DataFrame], key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ``base`` and ``spans``, arrays of (start, rank of the kind in KINDS, end).

    ``spans`` holds the base spans and the secrets that the tests add; both are in order of start and kind. Null and
    empty texts have none. Rows are judged one by one but for the cutoffs, so repeated rows are judged alike; an empty
    table gives no rows. Null keys stay null. Other columns are not read.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), plain.alias("text")).select(
        "key", "text", base_spans(F.col("text")).alias("base"))
    kept = durable(found.select("key", "base", candidates(F.col("text"), F.col("base")).alias("scored")), "candidates")
    least = cutoffs(kept, "scored")
    added = F.transform(F.filter("scored", lambda c: _discovered(c, least)), lambda c: F.struct(
        c["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), c["end"].alias("end")))
    return kept.select(F.col("key").alias(key), "base", F.sort_array(F.concat("base", added)).alias("spans"))


def report(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and a list of all spans."""
    def counted(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    of = {k: counted(k) for k in KINDS[:3]}
    return spans.select(key, *[c.alias(f"n_{k}") for k, c in of.items()],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _masked(text: Column, pattern: str, secret: Callable[[Column], Column], mask: str, group: int = 0) -> Column:
    def replaced(t: Column) -> Column:
        return let(_cut(t, pattern, group), lambda m: F.array_join(F.transform(m["gaps"], lambda gap, i: F.concat(
            gap, F.when(F.get(m["whole"], i).isNull(), F.lit("")).when(
                secret(F.get(m["part"], i)), F.lit(mask)).otherwise(F.get(m["whole"], i)))), ""))

    return let(text, lambda t: F.when(t.rlike(pattern), replaced(t)).otherwise(t))


def mask_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = "[secret]") -> DataFrame:
    """The documents, all of them, with each secret replaced by ``mask``; columns as they are.

    Assigned values are masked first, then what the tests find in runs that are not wholly of a base kind, then access
    keys and hex in the rest. ``length`` names a column with the number of characters, which follows the text where both
    are there. Null texts stay null.
    """
    body, full = F.col(text), lambda part: F.lit(True)
    assigned = _masked(body, ASSIGN, lambda part: F.length(part) >= LEAST_ASSIGNED, mask, 1)
    name, scored = fresh(docs, "_masked", "_scored")
    masked = docs.withColumn(name, assigned)

    def tested(found: Column) -> Column:
        return F.filter(_scored(found), lambda c: ~c["text"].rlike(f"^(?:{ACCESS}|{HEX})={{0,2}}$"))

    least = cutoffs(masked.select(tested(located(F.col(name), RUN)).alias(scored)), scored)

    def secret(part: Column) -> Column:
        one = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), part.alias("text")))
        return F.exists(tested(one), lambda c: _discovered(c, least))

    clean = _masked(F.col(name), RUN, secret, mask) if least else F.col(name)
    out = masked.withColumn(name, clean).withColumn(name, _masked(_masked(F.col(name), ACCESS, full, mask), HEX, full, mask))
    changed = {text: F.col(name)}
    if length is not None and length in docs.columns:
        kind = docs.schema[length].dataType
        changed[length] = F.when(F.col(length).isNotNull() & F.col(name).isNotNull(),
                                 F.length(name).cast(kind)).otherwise(F.col(length))
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
