"""Personal data by proposing patterns, confirming checksums and nearby context words.

Patterns propose spans; Luhn and mod-97 confirm numbers; words in the stretch before a span
raise its score, words of examples lower it, and spans of the method's own kinds need a score of
at least ``ACCEPT``: a bare serial number or a long random string is none, "token = ..." is a
secret.  All of it is built-in expressions, in time linear in a text and its spans.  The patterns are possessive, or anchored to the start of a run
by a look-behind, so that a long run of one character class costs its length and no more;
``\\G`` admits the place where the last match ended, as a leftmost scan would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import held

LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
ACCEPT, NEAR = 0.6, 40
#: Places of a run that are summed one after another, and code points of a block of a text.
RUN, CUT = 512, 4096
#: Words before a span that speak against it.
AGAINST = r"example|sample|dummy|fictitious|beispiel|exemple|ejemplo|\bisbn|version"
#: Total lengths of IBANs by country, as registered.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()


def iban_pattern() -> str:
    """One alternative for each registered length, so that a match can't run into the next word.

    Countries without a registered length take up to 30 characters after the check digits.
    """
    of: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS:
        of.setdefault(int(x[2:]), []).append(x[:2])
    body = r"[0-9]{2}(?:\x20?[A-Z0-9])"
    known = "|".join(rf"(?:{'|'.join(c)}){body}{{{n - 4}}}+" for n, c in sorted(of.items()))
    other = rf"(?!{'|'.join(x[:2] for x in IBAN_LENGTHS)})[A-Z]{{2}}{body}{{11,30}}+"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|{other})(?![A-Za-z0-9])"


#: kind -> (pattern, a cheap test of the whole text, score without context, context words)
KINDS: dict[str, tuple[str, str, float, str]] = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@", 0.9, r"mail|contact|write|courriel|correo|kontakt"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", "digit", 0.7, r"\bip\b|address|server|host|log"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "digit", 0.8, r"card|visa|credit|carte|karte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|call|tel|mobil|fax"),
    "iban": (iban_pattern(), "digit", 0.7, r"iban|account|bank|konto|compte|cuenta"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "digit", 0.4, r"ssn|social security"),
    "secret": (
        r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/.-]*[@.])", "digit", 0.4, r"token|secret|passw|api.?key|access.?key|credential|bearer"
    ),
    "mac": (r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])", "digit", 0.5, r"\bmac\b|device|ethernet|hardware|wifi|wlan"),
}
BASE = ("email", "ip", "card", "phone")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))
    n = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.lit(1)).cast("int"))
    twice = F.transform(n, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    code = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    rest = F.aggregate(
        code, F.lit(0), lambda a, c: F.when(c <= 57, a * 10 + (c - 48)).otherwise(a * 100 + (c - 55)) % 97
    )
    return rest % 97 == 1


def small_parts(m: Column) -> Column:
    def small(p: Column) -> Column:
        n = F.regexp_replace(p, "^0+", "")
        return (F.length(n) < 3) | ((F.length(n) == 3) & (n <= "255"))

    return F.forall(F.split(m, r"\."), small)


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return small_parts(m)
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return mod97(m) if kind == "iban" else F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative step over an array of integers.

    Runs of ``RUN`` places are worked out one by one and then moved by what stands before them,
    so that no step copies more than a run or the list of runs.
    """

    def along(a: Column) -> Column:
        def put(out: Column, x: Column) -> Column:
            last = F.try_element_at(out, F.lit(-1))
            return F.concat(out, F.array(F.when(last.isNull(), x).otherwise(step(last, x))))

        return F.aggregate(a, F.array().cast("array<int>"), put)

    def whole(a: Column) -> Column:
        first = F.sequence(F.lit(0), F.greatest(F.floor((F.size(a) - 1) / RUN), F.lit(0)).cast("int"))
        return let(F.transform(first, lambda r: along(F.slice(a, r * RUN + 1, F.lit(RUN)))), moved)

    def moved(runs: Column) -> Column:
        totals = along(F.transform(runs, lambda r: F.try_element_at(r, F.lit(-1))))
        return let(
            totals,
            lambda t: F.flatten(
                F.transform(runs, lambda r, k: F.when(k == 0, r).otherwise(let(F.get(t, k - 1), lambda by: F.transform(r, lambda x: step(by, x)))))
            ),
        )

    return let(values, whole)


def part(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks of ``CUT``."""
    first = F.floor(start / CUT).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
    return F.substring(some, start % CUT + 1, end - start)


def spans_of(kind: str, t: Column, found: Column) -> Column:
    """Array of (start, rank, end, kind, score): confirmed spans in code points, in order."""
    pattern, _, score, words = KINDS[kind]
    gaps = F.split(t, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    near = F.transform(gaps, lambda g: F.lower(F.substring(g, -NEAR, NEAR)))
    walk = F.filter(F.arrays_zip(found.alias("m"), running(sizes, lambda x, y: x + y).alias("end"), near.alias("near")), lambda z: z["m"].isNotNull())

    def scored(s: Column) -> Column:
        return F.struct(
            (s["end"] - F.length(s["m"])).alias("start"),
            F.lit(list(KINDS).index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            (F.lit(score) + F.when(s["near"].rlike(words), 0.3).otherwise(0.0) - F.when(s["near"].rlike(AGAINST), 0.2).otherwise(0.0)).alias("score"),
        )

    good = F.transform(F.filter(walk, lambda s: valid(kind, s["m"])), scored)
    return good if kind in BASE else F.filter(good, lambda s: s["score"] >= ACCEPT)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``pii_spans``: array of (start, rank, end, kind, score).

    Offsets count code points, end exclusive; sorted by start, then by kind as in ``KINDS``.
    Null and empty texts have an empty array.  All columns and rows of ``docs`` stay; a column
    of the name ``pii_spans`` is replaced.  Patterns run only on texts that pass their kind's
    cheap test; positions are worked out only where the pattern found something.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    names = [c for c in docs.columns if c != "pii_spans"]
    digit = t.rlike("[0-9]")
    test = {"@": t.contains("@"), "+": t.contains("+"), "digit": digit}
    none = F.lit(None).cast("array<string>")
    found = docs.select(
        *names,
        *[
            held(F.when(test[cheap], F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)).alias(f"_m_{kind}")
            for kind, (pattern, cheap, *_) in KINDS.items()
        ],
    )
    parts = [
        F.when(F.size(f"_m_{kind}") > 0, spans_of(kind, t, F.col(f"_m_{kind}"))).otherwise(F.array().cast(SPAN)).cast(SPAN)
        for kind in KINDS
    ]
    return found.select(*names, held(F.array_sort(F.concat(*parts))).alias("pii_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each found span of ``text_col`` replaced by its kind in brackets.

    Overlapping spans become one replacement that bears the first one's kind.  Null texts stay
    null; texts without spans stay as they are.
    """
    t, spans = F.col(text_col), F.col("pii_spans")
    # where a span starts at or behind all earlier ends, a replacement starts
    heads = lambda top: F.filter(
        F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), F.when(i > 0, F.get(top, i - 1)).otherwise(0).alias("from"), s["kind"].alias("kind"))),
        lambda h: h["start"] >= h["from"],
    )
    built = lambda top, blocks: F.concat(
        F.array_join(
            F.transform(heads(top), lambda h: F.concat(part(blocks, h["from"], h["start"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))), ""
        ),
        part(blocks, F.element_at(top, -1), F.length(t)),
    )
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    walk = let(ends, lambda top: let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), lambda blocks: built(top, blocks)))
    names = list(docs.columns)
    return find_spans(docs, text_col).select(
        *[F.when(F.size("pii_spans") > 0, walk).otherwise(t).alias(c) if c == text_col else F.col(c) for c in names]
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Span counts of the base kinds, ``base_spans`` and ``spans`` as text, for each row.

    Null and empty texts have counts of 0 and empty lists.  Repeated rows and null ids each give
    a row; other columns are ignored; an empty table gives no rows.
    """
    spans = F.col("pii_spans")
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    return find_spans(docs.select(F.col(id_col), F.col(text_col)), text_col).select(
        F.col(id_col), *map(of, BASE), span_text(base).alias("base_spans"), span_text(spans).alias("spans"), "pii_spans"
    )
