"""Secret scan: fixed patterns plus a randomness test battery with false-discovery control [native]."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_or_empty

# The base kinds in their order, as Java patterns; letters of the first group in either case.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs of AKIA[A-Z0-9]+ that have 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that have 24 characters or more

#: Kinds that the test battery adds, by inferred encoding.
RANDOM_KINDS = ("random_hex", "random_base32", "random_base64")
#: A candidate is a run of encoding characters at least this long; '=' is padding at its end and separates runs elsewhere.
MIN_RUN = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_RUN},}}={{0,2}}"
#: A run with signs of both base64 alphabets is cut into parts of each.
PLAIN_PART = rf"[A-Za-z0-9+/]{{{MIN_RUN},}}={{0,2}}"
URL_PART = rf"[A-Za-z0-9_-]{{{MIN_RUN},}}={{0,2}}"
#: Symbols of each encoding in order of value; upper-case hex is read as lower case, URL-safe base64 as the plain one.
SYMBOLS = {
    "random_hex": "0123456789abcdef",
    "random_base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "random_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Costs of a letter after each letter, a row a letter, and of a first letter, in thirds of a bit as base-36 digits: counted on
#: prose in four languages and on program text, mixed with the letters' own frequencies and with equal ones.
PAIRS = (
    "HHDFEMIIDPMCE7HHPBB8DLLMLQ CMIJ6MNJFFP6MHBLQGHICPPPCP BOJKAMN6AQEDLH8MQFIBHPOPLQ BIKH5LMF9QPGMFAMQFEEGPKOLQ BKFCDHLHDQOCI8GIL7ACILLHLM ALJJBELI7ROEMG7KQAHDDOOPKO "
    "BIKL5MHDCRNEICEKQCBDFMKPNM 8ILL4NLECRNGMECLQFECJNJPNN GJEHBFHJIQOEG69JOFBALKOLOL 5OLL6NNJGQMKNHAJQJCIDPLPMQ CNKI3LHJCQPHMFILQHDHGOEPNQ BMLG6BMJAQPBMHDLQIEFFNOPAQ "
    "8HMJ5MNJBROHFHCAQIFHGPOPMQ CIF99JAFEPLGLEBKOGD8IKKPMO HJGFFCKJFPLGF5GGP8EEALJNOP 7OLJ8DNHDRMCNHAEQAGBFOOPEQ IOMKGMNJJRQJNHJMPIII1OPPOQ BIIH5LHGCQLHICBLPDDCHLKPIO "
    "FLCK7MKACOMHJGEGNHD6FOLPJQ CLJK9LN58ROIMGCKQCFEFOMOHJ EHIJ7IKIEROCF9FENACBLMNCOO 7NKL4MNJ8RPKMHDMQIJILPOPNQ 9OMJCMN48RPJNFDNQDHILPMPOQ BI9H9HNJCRPGGHEBKFI6LJPJHP "
    "EIJIALGEDQPDHCC8QEA9LNEPOO CHHK7MIHDNKHIHFKMHEF4KPPML"
)
FIRST = "CJGF8HHCCNLEHACHMBDBFLKKIM"
#: Costs in bits between kinds of characters (upper, lower, digit, other; at the start first): each row's shares add up to one.
KIND_SHARES = {"": (0.3, 0.5, 0.1, 0.1), "upper": (0.5, 0.38, 0.05, 0.07), "lower": (0.07, 0.82, 0.04, 0.07), "digit": (0.05, 0.1, 0.8, 0.05), "other": (0.25, 0.45, 0.2, 0.1)}
#: Upper ends of the length classes within which, for each encoding, false discoveries are controlled.
LENGTH_CLASSES = (24, 32, 48, 96)
#: Log p-values are counted in bins of this width, up to MAX_BIN of them, so that ranks over the corpus need no sort.
BIN, MAX_BIN = 0.05, 1200
#: Characters of a candidate that are taken apart at once.
STRETCH = 4096
_SPANS = "array<struct<start:int,kind:string,end:int,token:string>>"


def _prose_costs() -> list[str]:
    """Cost of each character after nothing (first row) and after each of the 54 characters, in eighths of a bit as code points from 32.

    Characters: A to Z, a to z, a digit, any other. A character costs the change of kind, then the letter (after a letter by
    their pair), the digit (of ten) or the sign (of four).
    """
    kinds = ["upper"] * 26 + ["lower"] * 26 + ["digit", "other"]
    pairs = PAIRS.split()
    out = []
    for i in range(-1, 54):
        row, share = "", KIND_SHARES[kinds[i] if i >= 0 else ""]
        for j, kind in enumerate(kinds):
            cost = -math.log2(share[("upper", "lower", "digit", "other").index(kind)])
            # a capital after a small letter begins a word
            letters = pairs[i % 26] if 0 <= i < 52 and not (i >= 26 and j < 26) else FIRST
            cost += {"digit": math.log2(10), "other": 2.0}.get(kind) or int(letters[j % 26], 36) / 3
            row += chr(32 + round(8 * cost))
        out.append(row)
    return out


def _bound(value: Column, f) -> Column:
    """``f(value)``, where ``value`` is computed once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _ends(lengths: Column) -> Column:
    """Running sums of an array of numbers.

    Done by about sqrt(n) stretches of sqrt(n): their totals are summed up first, then the numbers within each, so the work is
    n * sqrt(n) additions and no array is copied for each of its elements.
    """

    def within(x: Column) -> Column:
        total = lambda y: F.aggregate(y, F.lit(0), lambda a, b: a + b)
        step = x["step"]
        stretches = F.transform(F.sequence(F.lit(0), F.size(x["v"]) - 1, step), lambda at: F.slice(x["v"], at + 1, step))
        with_base = _bound(
            F.struct(stretches.alias("s"), F.transform(stretches, total).alias("t")),
            lambda y: F.transform(y["s"], lambda v, k: F.struct(v.alias("v"), total(F.slice(y["t"], F.lit(1), k)).alias("base"))),
        )
        return F.flatten(F.transform(with_base, lambda y: F.transform(y["v"], lambda _, k: y["base"] + total(F.slice(y["v"], F.lit(1), k + 1)))))

    return _bound(F.struct(lengths.alias("v"), F.ceil(F.sqrt(F.size(lengths))).cast("int").alias("step")), within)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, token), leftmost and non-overlapping, in code points.

    The pieces between the matches (``split``) and the matches alternate, so running sums of their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(m: Column) -> Column:
        ends = _ends(F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda p, x: F.length(p) + F.length(x)))
        span = lambda x, end: F.struct((end - F.length(x)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x.alias("token"))
        return F.when(F.size(m) > 0, F.zip_with(m, ends, span)).otherwise(F.array().cast(_SPANS))

    return _bound(found, place)


def _blanked(text: Column) -> Column:
    """The text with the base kinds' spans, one kind after the other, replaced by as many line feeds."""

    def blank(pattern: str, least: int):
        def feeds(m: Column) -> Column:
            out = F.repeat(F.lit("\n"), F.length(m))
            return F.when(F.length(F.regexp_extract(m, pattern, 2)) >= least, out).otherwise(m) if least else out

        def without(t: Column) -> Column:
            found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), feeds)
            joined = F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
            return F.when(t.rlike(pattern), joined).otherwise(t)

        return without

    for pattern, least in ((ASSIGN, 6), (ACCESS, 0), (HEX, 0)):
        text = _bound(text, blank(pattern, least))
    return text


def _candidates(text: Column) -> Column:
    """Runs of one alphabet; of runs that mix both alphabets' signs, the parts in either, which can overlap (but never are equal)."""

    def parts(s: Column) -> Column:
        token = s["token"]
        mixed = token.rlike("[+/]") & token.rlike("[_-]")
        both = F.concat(_spans(token, PLAIN_PART, "candidate"), _spans(token, URL_PART, "candidate"))
        moved = F.transform(both, lambda x: F.struct((x["start"] + s["start"]).alias("start"), x["kind"].alias("kind"), (x["end"] + s["start"]).alias("end"), x["token"].alias("token")))
        return F.when(mixed, moved).otherwise(F.array(s))

    return F.flatten(F.transform(_spans(text, CANDIDATE, "candidate"), parts))


def base_spans(text: Column) -> Column:
    """The three fixed kinds, by start, then kind as listed."""
    assign = _spans(text, ASSIGN, "assign")
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2)) >= 6)
    spans = F.concat(assign, _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    return _ordered(spans)


def _ordered(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate((*BASE_KINDS, *RANDOM_KINDS))}
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), ranks[s["kind"]].alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _phi(z: Column) -> Column:
    """Normal distribution function by a logistic curve (error below 2e-4; decreasing tails stay ordered)."""
    t = 1.5976 * z + 0.07056 * z * z * z
    return 1 / (1 + F.exp(-F.greatest(F.least(t, F.lit(700.0)), F.lit(-700.0))))


def _two_sided(z: Column) -> Column:
    return F.greatest(2 * _phi(-F.abs(z)), F.lit(1e-12))


def _encoding(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    return (
        F.when(body.rlike("^[0-9]+$"), None)  # plain numbers are no encoded bytes
        .when(body.rlike("^[0-9a-f]+$") | body.rlike("^[0-9A-F]+$"), "random_hex")
        .when(body.rlike("^[A-Z2-7]+$"), "random_base32")
        .when(body.rlike("^[A-Za-z0-9+/]+$") | body.rlike("^[A-Za-z0-9_-]+$"), "random_base64")
    )


def _walk(token: Column, zero: Column, step) -> Column:
    """``step`` over the characters of a token, a stretch of them at a time, so that no array is as long as the token."""
    return F.aggregate(F.regexp_extract_all(token, F.lit(f".{{1,{STRETCH}}}"), F.lit(0)), zero, lambda acc, some: F.aggregate(F.split(some, ""), acc, step))


def _prose_bits(plain: Column) -> Column:
    """Minus the binary log of the token's chance as prose or identifiers."""
    rows = F.array(*[F.lit(x) for x in _prose_costs()])
    kind = lambda c: F.when(c.between("A", "Z"), F.ascii(c) - 64).when(c.between("a", "z"), F.ascii(c) - 70).when(c.between("0", "9"), 53).otherwise(54)
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("bits"))
    add = lambda acc, k: F.struct(k.alias("at"), (acc["bits"] + (F.ascii(F.substring(F.element_at(rows, acc["at"] + 1), k, F.lit(1))) - 32) / 8.0).alias("bits"))
    return _walk(plain, zero, lambda acc, c: _bound(kind(c), lambda k: add(acc, k)))["bits"]


def battery(token: Column, encoding: Column) -> Column:
    """Struct of ``p_uniform``, ``p_runs``, ``p_serial``, ``p_random`` and ``log10_prose`` for a token read in an encoding.

    The three tests of randomness: chi-square for equal use of the alphabet (Wilson-Hilferty), the number of runs above and
    below its middle, and the lag-one serial correlation. ``p_random`` is three times the least of their p-values, which
    holds however they depend on one another.
    ``log10_prose`` bounds the log p-value under prose and identifiers by the likelihood ratio: the chance of the token under a
    model of letter pairs, case, digits and signs, over its chance as equally likely symbols of the encoding. (Under
    the model a ratio below p has a chance below p.)
    """
    size = F.when(encoding == "random_hex", 16.0).when(encoding == "random_base32", 32.0).otherwise(64.0)
    alphabet = F.when(encoding == "random_hex", SYMBOLS["random_hex"]).when(encoding == "random_base32", SYMBOLS["random_base32"]).otherwise(SYMBOLS["random_base64"])
    plain = F.regexp_replace(token, "=+$", "")
    body = F.when(encoding == "random_hex", F.lower(plain)).when(encoding == "random_base64", F.translate(plain, "-_", "+/")).otherwise(plain)
    names = ("first", "last", "sum", "squares", "products", "changes", "high")
    zero = F.struct(*(F.lit(-1.0 if k in ("first", "last") else 0.0).alias(k) for k in names))

    def sums(x: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            def add(v: Column) -> Column:
                begun, high = acc["last"] >= 0, v >= x["m"] / 2
                new = (
                    F.when(begun, acc["first"]).otherwise(v), v, acc["sum"] + v, acc["squares"] + v * v, F.when(begun, acc["products"] + acc["last"] * v).otherwise(0.0),
                    F.when(begun & (high != (acc["last"] >= x["m"] / 2)), acc["changes"] + 1).otherwise(acc["changes"]), F.when(high, acc["high"] + 1).otherwise(acc["high"]),
                )
                return F.struct(*(e.alias(k) for k, e in zip(names, new, strict=True)))

            return _bound(F.position(c, x["alphabet"]).cast("double") - 1, add)

        n = F.length(x["body"])
        uses = F.aggregate(F.split(x["alphabet"], ""), F.lit(0.0), lambda acc, c: acc + F.pow((n - F.length(F.replace(x["body"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.struct(_walk(x["body"], zero, step).alias("s"), uses.alias("uses"), n.cast("double").alias("n"), x["m"].alias("m"), x["prose"].alias("prose"))

    def ratios(x: Column) -> Column:
        s, n, df = x["s"], x["n"], x["m"] - 1
        wilson = (F.pow((x["m"] / n * x["uses"] - n) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * s["high"] * (n - s["high"])
        var_runs = F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))
        z_runs = F.when(both > 0, (s["changes"] - both / n) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
        mean = s["sum"] / n
        cross = s["products"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
        z_serial = (cross / F.greatest(s["squares"] - n * mean * mean, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
        return F.struct(
            F.greatest(_phi(-wilson), F.lit(1e-12)).alias("p_uniform"), _two_sided(z_runs).alias("p_runs"), _two_sided(z_serial).alias("p_serial"),
            F.least((n * F.log2(x["m"]) - x["prose"]) * math.log10(2), F.lit(0.0)).alias("log10_prose"),
        )

    def joined(x: Column) -> Column:
        p = F.least(F.lit(1.0), 3 * F.least(x["p_uniform"], x["p_runs"], x["p_serial"]))
        return F.struct(x["p_uniform"], x["p_runs"], x["p_serial"], p.alias("p_random"), x["log10_prose"])

    given = F.struct(body.alias("body"), alphabet.alias("alphabet"), size.alias("m"), _prose_bits(plain).alias("prose"))
    return _bound(_bound(_bound(given, sums), ratios), joined)


def _class(kind: Column, n: Column) -> Column:
    """Number of the encoding and length class."""
    out = F.lit(len(LENGTH_CLASSES))
    for i, top in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(n <= top, i).otherwise(out)
    for i, k in enumerate(RANDOM_KINDS[1:], 1):
        out = F.when(kind == k, out + i * (len(LENGTH_CLASSES) + 1)).otherwise(out)
    return out


def scan_secrets(docs: DataFrame, text: str = "text", q: float = 0.01, q_dropped: float = 0.001, keep_text: bool = True) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, kind, end, token), starts in code points, ends exclusive.

    Base spans are the fixed patterns. Added spans are runs of encoding characters (of runs that mix the base64 alphabets,
    parts in one of them) in the text with its base spans blanked out; runs of digits alone are no candidates. False discoveries are
    controlled twice, each time within the candidate's encoding and length class, with ranks over all candidates of all
    documents (Benjamini-Hochberg on binned log p-values, each rounded up to its bin's end, so the rates hold):

    * candidates that the battery of randomness tests rejects at rate ``q_dropped`` are dropped: of those dropped, at
      most that share is expected to be random after all;
    * of the others those are reported whose likeness to prose is rejected at rate ``q``: of those reported, at most that share is
      expected to be prose or identifiers.

    A null text counts as empty and has no spans; repeated rows each keep theirs; an empty table gives an empty result. Very
    long texts are read whole: work grows with the number of matches times its square root, and a long candidate is taken
    apart by stretches. Other columns pass through, whatever their names, though columns named ``base`` and ``spans`` are replaced.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    kept = docs.drop("base", "spans", *([] if keep_text else [text]))
    row = F.struct(*(docs[f"`{c}`"] for c in kept.columns)) if kept.columns else F.lit(None)
    found = docs.select(row.alias("row"), base_spans(whole).alias("base"), _bound(_blanked(whole), _candidates).alias("found"))
    tested = F.transform(
        F.filter(F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"), _encoding(s["token"]).alias("kind"))), lambda s: s["kind"].isNotNull()),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"), _class(s["kind"], s["end"] - s["start"]).alias("cls"), battery(s["token"], s["kind"]).alias("b")),
    )
    bin_of = lambda x: F.least(F.floor(-x / BIN).cast("int"), F.lit(MAX_BIN))
    binned = F.transform(
        tested,
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"), s["cls"].alias("cls"),
            bin_of(F.log10(s["b"]["p_random"])).alias("odd"), bin_of(s["b"]["log10_prose"]).alias("bin"),
        ),
    )
    found = materialize(found.select("row", "base", binned.alias("cands")), "secret-candidates")
    random, telling = _cuts(found, "odd", q_dropped), _cuts(found, "bin", q)
    never = F.lit(MAX_BIN + 1)
    passes = lambda s: (s["odd"] < F.coalesce(random[s["cls"]], never)) & (s["bin"] >= F.coalesce(telling[s["cls"]], never))
    added = F.transform(F.filter("cands", passes), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token")))
    spans = _ordered(F.concat("base", added))
    return found.select(*([F.col("row.*")] if kept.columns else []), "base", spans.alias("spans"))


def _cuts(found: DataFrame, name: str, q: float) -> Column:
    """Map from encoding and length class to the lowest bin that Benjamini-Hochberg rejects; a row for each class is all that is gathered."""
    counts = found.select(F.explode("cands").alias("c")).groupBy("c.cls", F.col(f"c.{name}").alias("bin")).count()
    by_cls = Window.partitionBy("cls")
    ranked = counts.select("cls", "bin", F.sum("count").over(by_cls.orderBy(F.desc("bin"))).alias("rank"), F.sum("count").over(by_cls).alias("m"))
    best = ranked.filter(-F.col("bin") * BIN <= F.log10(F.lit(q) * F.col("rank") / F.col("m"))).groupBy("cls").agg(F.min("bin").alias("bin")).collect()
    pairs = [F.lit(x) for r in sorted(best) for x in (r["cls"], r["bin"])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<int,int>")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of base kinds, digest of the base spans, all spans."""
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"].startswith("random"))).cast("long").alias("n_random"),
    )
