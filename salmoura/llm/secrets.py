"""Secret scans: three written patterns, and random-looking strings found by a battery of tests.

The patterns are assignments to a secret's name, access keys and long hexadecimal runs; each is matched from the
left without overlap, matches that are too short are dropped.

The battery takes every run of at least ``RUN`` letters, digits and ``+/_=-``, and infers its alphabet from the kinds
of letters that occur (digits, hexadecimal, also parted by dashes, upper or lower case alone, base 32 and base 36 of either
case, base 52, base 62, else base 64). A run is added if it passes for random and cannot be prose:

* random: chi-squared tests of eight parts of the alphabet and of its upper case, lower case and other
  letters, test of the number of runs above and below its middle, and serial correlation of neighbours, combined by Fisher's rule, give no p-value below ``LEAST_P``;
* not prose: the run is so many times likelier as random letters of its alphabet than in a model of prose (kinds that
  follow each other, letters that follow each other, numbers that count on) that prose reaches the ratio r with a
  chance of 1/r at most (Markov), whatever the kinds. Benjamini-Hochberg on that bound keeps the expected share of false
  finds below ``FALSE_SHARE`` among the runs of each length class of the whole corpus. Longer runs are a class of their own,
  so the many short ones do not pass at their expense. p-values are rounded up to tenths of a decade, so that
  a table of at most 64 classes x 401 steps holds all that is needed.

Only column functions are used; texts are matched whole. Positions are code points, ends exclusive.

Defined results: null counts as the empty text, which has no spans; repeated rows have spans of their own and count
as tests of their own; an empty table gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.llm.common import let, written
from salmoura.names import col

# fixed values: the patterns of the written kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA and more, 18 or more in all
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12

RUN = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
DASHED = "^(?=.*[a-fA-F])([0-9a-f]+(-[0-9a-f]+)+|[0-9A-F]+(-[0-9A-F]+)+)$"  # as in UUIDs
FALSE_SHARE = 0.01
LEAST_P = 0.001
STEPS = 400
PARTS = 8
ALPHABETS = 12      # ways to read a run
KINDS = ("assign", "access", "hex", "random")
_BLOCK = 128

# prose: what follows a lower-case letter, capital, digit and sign (by kind, in this order)
OTHER = 0.2
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
KIND_NEXT = ((0.95, 0.01, 0.01, 0.03), (0.2, 0.75, 0.02, 0.03), (0.02, 0.02, 0.91, 0.05), (0.5, 0.2, 0.25, 0.05))
# and which letter follows which: a row for each letter, -4 ln of the chance as a character from 0 on, counted in 490,000
# letters of the docstrings of Python's library and smoothed by one in 1,250. LETTERS are the shares of letters in English,
# French, German and Spanish on average; the share OTHER counts as drawn from them, as other tongues have other pairs
FOLLOWS = """
K>;=KE?K=LC8;7M?L8:7@AEG@L
:E?B7JKI<7L8FG;EL>>D9JLJ;J
9LAF8LL:=L;;HJ7JI>B7=LLLFL
:FH<4IIL6IL@ID;GL><D;JIIBL
<G:9@>AIDLI<>8G?B88;JBD=BK
:LIG<<KL5LL>KJ5LL:D?:KKLCL
>LKK5IA<8LL;E;?HL<9B7IKLJE
8LLL2JLL9LLHFG:LL?HBELLLHL
?@<?>??MKME:=59BJ>;9K>LDMB
FKDK1KKKIKKKKH?KKKKK:KKKKK
<LFB3G?L:LL;L>?>LI:HAD>LHL
9DG>5;GJ8LJ9LG;CLF=<<IFL<K
7;LG4HLL<LIE=G99LI@I>LKLEL
:I:89B8I?LCBHB;DLK:7?BKLBK
D<=:CEDLCLD>;6A<M7>;;@?EKK
8JDE7ILC=LG9GI9<L8B9=KLLAL
GJJJJJJJJJJGGJJJJDJJ0JJJJJ
9GA?5D<K9LCD><:EL><;@CDL>L
>L?K5HF>9LEDFD><JH96<KHL@L
:LDG7HM48MM@GJ=DM;<@<LCK?L
@@?C:BBL?LL898D=L799JLLLLL
5IKL3LHK8LLLIK@IJLIJKJKLJJ
9LLG;IL64LL?K>9LL;@JLLDGLL
9F6G:BLF8LLEGLI9LDH5JGLLHI
HIC?<LBJ:LL?><:6IC76LG=LLH
;GBJ1JJJ9JJGAE<JJEJBJJJJGG
"""
LETTERS = ":A><8A@>;FE<>:;@D;:;=BBICF"


def _prefix_sums(sizes: Column) -> Column:
    """Sums of all earlier elements, in blocks so that many matches stay cheap."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
        lambda b: total(F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))),
    )
    return let(blocks, lambda sums: F.transform(sizes, lambda _, i: total(
        F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int"))
    ) + total(F.slice(sizes, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as (start, end, value): the parts between matches tell where they are."""
    located = let(
        F.struct(
            F.transform(F.split(text, pattern, -1), F.length).alias("between"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        ),
        lambda m: let(
            F.transform(m["found"], lambda s, i: m["between"][i] + F.length(s)),
            lambda sizes: let(_prefix_sums(sizes), lambda before: F.transform(
                m["found"], lambda s, i: F.struct(
                    (before[i] + m["between"][i]).alias("start"),
                    (before[i] + m["between"][i] + F.length(s)).alias("end"),
                    m["value"][i].alias("value"),
                ))),
        ),
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), located).otherwise(none)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (error below 2e-7; Abramowitz and Stegun 7.1.26)."""
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

    def series(t: Column) -> Column:
        total = F.lit(0.0)
        for a in reversed(terms):
            total = (total + F.lit(a)) * t
        return total

    return let(F.lit(1.0) / (F.lit(1.0) + x * 0.3275911), series) * F.exp(-x * x)


def encoding(run: Column) -> Column:
    """The alphabet that a run is read in, by the kinds of letters that occur: its letters, the run in them, and how
    many of 64 random letters fall in each part and are upper case, lower case and others."""
    digits = "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()

    def read_as(letters: str, text: Column) -> Column:
        size = len(letters)
        parts = [64 * sum(i * PARTS // size == k for i in range(size)) / size for k in range(PARTS)]
        shares = [64 * sum(c in kind for c in letters) / size for kind in (upper, lower)]
        return F.struct(
            F.lit(letters).alias("letters"), text.alias("text"), F.array(*map(F.lit, parts)).alias("parts"),
            F.array(*map(F.lit, [*shares, 64.0 - sum(shares)])).alias("shares"),
        )

    bare = F.rtrim(run, F.lit("="))
    return (
        F.when(run.rlike("^[0-9]+$"), read_as(digits, run))
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$"), read_as(digits + "abcdef", F.lower(run)))
        .when(run.rlike(DASHED), read_as(digits + "abcdef", F.lower(F.translate(run, "-", ""))))
        .when(run.rlike("^[A-Z]+=*$"), read_as(upper, bare))
        .when(run.rlike("^[a-z]+=*$"), read_as(lower, bare))
        .when(run.rlike("^[A-Z2-7]+=*$"), read_as(upper + "234567", bare))
        .when(run.rlike("^[a-z2-7]+=*$"), read_as(lower + "234567", bare))
        .when(run.rlike("^[A-Z0-9]+=*$"), read_as(digits + upper, bare))
        .when(run.rlike("^[a-z0-9]+=*$"), read_as(digits + lower, bare))
        .when(run.rlike("^[A-Za-z]+=*$"), read_as(upper + lower, bare))
        .when(run.rlike("^[A-Za-z0-9]+=*$"), read_as(upper + lower + digits, bare))
        .otherwise(read_as(upper + lower + digits + "+/", F.rtrim(F.translate(run, "-_", "+/"), F.lit("="))))
    )


def random_p(run: Column) -> Column:
    """Combined p-value of the four tests against a uniformly random string of the run's alphabet.

    An alphabet of one kind of letters leaves three tests, as the kinds say nothing."""
    def battery(e: Column) -> Column:
        size = F.length(e["letters"])
        codes = F.filter(
            F.transform(F.split(e["text"], ""), lambda c: F.when(c != "", F.instr(e["letters"], c))),
            lambda c: c > 0,
        )
        upper_case = F.regexp_count(e["text"], F.lit("[A-Z]"))
        lower_case = F.regexp_count(e["text"], F.lit("[a-z]"))
        kinds = F.array(upper_case, lower_case, F.length(e["text"]) - upper_case - lower_case)
        return let(F.struct(
            codes.alias("codes"), size.cast("double").alias("size"), e["parts"].alias("parts"),
            e["shares"].alias("shares"), kinds.alias("kinds")
        ), tests)

    def tests(s: Column) -> Column:
        codes, size = s["codes"], s["size"]
        n = F.size(codes).cast("double")

        def total(values: Column) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

        part = F.transform(codes, lambda c: F.floor((c - 1) * PARTS / size).cast("int"))
        chi = let(part, lambda q: total(F.transform(F.array(*map(F.lit, range(PARTS))), lambda k: let(
            n * s["parts"][k] / 64, lambda due: let(F.size(F.filter(q, lambda x: x == k)) - due, lambda d: d * d / due)))))
        pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        middle, spread = (size + 1) / 2, (size * size - 1) / 12
        changes = let(pairs, lambda p: F.struct(
            total(F.transform(p, lambda x: F.when((x["a"] > middle) == (x["b"] > middle), 0.0).otherwise(1.0))).alias("runs"),
            total(F.transform(p, lambda x: (x["a"] - middle) * (x["b"] - middle) / spread)).alias("serial"),
        ))
        z = let(changes, lambda c: F.struct(
            F.abs((c["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"),
            F.abs(c["serial"] / F.sqrt(n - 1)).alias("serial"),
        ))
        # upper tail with PARTS - 1 = 7 degrees of freedom
        chi_p = let(chi, lambda x: _erfc(F.sqrt(x / 2)) + F.sqrt(x * (2 / math.pi)) * F.exp(-x / 2) * (
            1 + x / 3 + x * x / 15))
        off = total(F.zip_with(s["kinds"], s["shares"], lambda found, share: F.when(
            share > 0, let(found - n * share / 64, lambda d: d * d / (n * share / 64))).otherwise(F.lit(0.0))))
        of_kinds = F.size(F.filter(s["shares"], lambda share: share > 0))
        kinds_p = let(off, lambda x: F.when(of_kinds == 3, F.exp(-x / 2)).otherwise(_erfc(F.sqrt(x / 2))))
        rest = let(z, lambda v: F.array(_erfc(v["runs"] / math.sqrt(2)), _erfc(v["serial"] / math.sqrt(2))))
        half = -total(F.transform(F.concat(
            F.array(chi_p, F.when(of_kinds == 1, 1.0).otherwise(kinds_p)), rest), lambda p: F.ln(F.greatest(p, F.lit(1e-300)))))
        fisher = let(half, lambda h: F.exp(-h) * (
            1 + h + h * h / 2 + F.when(of_kinds == 1, 0.0).otherwise(h * h * h / 6)))
        return F.when(n >= RUN // 2, fisher).otherwise(F.lit(0.0))

    return let(encoding(run), battery)


def prose_costs() -> list[int]:
    """-1000 ln of the chance that prose goes on from one character to another, for each pair of ``SYMBOLS``."""
    def chances(coded: str) -> list[float]:
        found = [math.exp((48 - ord(c)) / 4) for c in coded]
        return [x / sum(found) for x in found]

    alone = chances(LETTERS)
    after = [[(1 - OTHER) * x + OTHER * y for x, y in zip(chances(row), alone)] for row in FOLLOWS.split()]
    spans_of = (range(26), range(26, 52), range(52, 62), range(62, 67))

    def within(a: int, b: int, kind: int) -> float:
        """Chance of ``b`` after ``a``, given its kind."""
        if kind < 2:  # a capital and the small letter after it go together
            together = a < 52 and (kind == (a >= 26) or (a >= 26 and kind == 0))
            return after[a % 26][b % 26] if together else alone[b % 26]
        if kind == 2:  # numbers count on and repeat
            return 0.05 + {1: 0.25, 0: 0.15, 9: 0.1}.get((b - a) % 10, 0.0) if 52 <= a < 62 else 0.1
        return 0.2

    costs = []
    for a in range(67):
        of = next(k for k, r in enumerate(spans_of) if a in r)
        for kind, r in enumerate(spans_of):
            costs += [round(-1000 * math.log(KIND_NEXT[of][kind] * within(a, b, kind))) for b in r]
    return costs


def prose_step(run: Column) -> Column:
    """-10 log10 of the bound on the chance that prose looks as random, rounded down, at most STEPS."""
    table = F.expr(f"array({','.join(map(str, prose_costs()))})")
    bare = F.rtrim(run, F.lit("="))
    # a dash that parts hexadecimal digits counts as one more letter
    letters = F.length(encoding(run)["letters"]) + F.when(run.rlike(DASHED), 1).otherwise(0)
    codes = F.filter(
        F.transform(F.split(bare, ""), lambda c: F.when(c != "", F.instr(F.lit(SYMBOLS), c) - 1)), lambda c: c >= 0)

    def step(c: Column) -> Column:
        prose = F.aggregate(
            F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: table[a * 67 + b]),
            F.lit(0).cast("bigint"), lambda total, x: total + x,
        )
        ratio = prose / 1000 - (F.size(c) - 1) * F.ln(letters) - math.log(ALPHABETS)
        return F.greatest(F.lit(0), F.least(F.floor(ratio * (10 / math.log(10))), F.lit(STEPS))).cast("int")

    return let(codes, lambda c: F.when(F.size(c) > 1, step(c)).otherwise(F.lit(0)))


def _found(text: Column) -> tuple[Column, Column]:
    """Spans of the written kinds, as (start, kind, end) in order; and the runs put to the battery."""
    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    assign = F.filter(spans(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGNED)
    base = F.array_sort(F.concat(of(0, assign), of(1, spans(text, ACCESS)), of(2, spans(text, HEX))))
    tested = F.transform(spans(text, CANDIDATE), lambda s: let(prose_step(s["value"]), lambda step: F.struct(
        s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"),
        F.least(F.floor(F.log2((s["end"] - s["start"]).cast("double"))), F.lit(63)).cast("int").alias("length_class"),
        step.alias("step"),
        # most runs are words, which need no battery
        F.when(step > 0, random_p(s["value"]) >= LEAST_P).otherwise(F.lit(False)).alias("random"),
    )))
    return base, tested


def cuts(tested: DataFrame) -> dict[int, int]:
    """Benjamini-Hochberg per length class: the least step at which a run counts as found."""
    counts = tested.groupBy("length_class", "step").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("length_class").orderBy(F.desc("step"))
    every = Window.partitionBy("length_class")
    kept = (
        counts.withColumn("as_far", F.sum("n").over(down)).withColumn("m", F.sum("n").over(every))
        .filter(F.pow(F.lit(10.0), -F.col("step") / 10.0) * F.col("m") <= F.col("as_far") * FALSE_SHARE)
        .groupBy("length_class").agg(F.min("step").alias("step"))
    )
    return {r["length_class"]: r["step"] for r in kept.collect()}  # at most 64 rows


def _listed(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, numbers of spans of the written kinds, their digest, and all spans."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    base, tested = _found(F.col("_text"))
    found, _ = written(
        documents.select(col(doc_id).alias("_id"), body.alias("_text"))
        .select("_id", base.alias("base"), tested.alias("tested"))
    )
    least = cuts(found.select(F.explode("tested").alias("t")).select("t.length_class", "t.step"))

    def cut(t: Column) -> Column:
        out = F.lit(STEPS + 1)
        for length_class, step in least.items():
            out = F.when(t["length_class"] == length_class, F.lit(step)).otherwise(out)
        return out

    added = F.filter("tested", lambda t: t["random"] & (t["step"] >= cut(t)) & ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    plain = F.transform(added, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        F.col("_id").alias(doc_id), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", plain))).alias("spans"),
    )
