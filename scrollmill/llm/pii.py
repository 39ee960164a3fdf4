"""Personal data: patterns propose, checksums confirm, context adjusts the score.

DataFrame functions only. Matches come from ``regexp_extract_all`` and their
places from the pieces that ``split`` leaves between them; both walk a text with
the same matcher. Patterns are written so that no text makes them backtrack over
more than a run: possessive repeats, and starts only at a run's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Card numbers without marks or in the groups that are printed: 4-4-4-4(-3), 4-6-5, 4-6-4.
_PAN = "^([0-9]{14,19}|[0-9]{4}([\\\\x20-])[0-9]{4}\\\\2[0-9]{4}\\\\2[0-9]{4}(\\\\2[0-9]{3})?|[0-9]{4}([\\\\x20-])[0-9]{6}\\\\4[0-9]{4,5})$"
_IBAN = "^[A-Z]{2}[0-9]{2}(\\\\x20?[A-Z0-9]{4}){2,7}(\\\\x20?[A-Z0-9]{1,3})?$"
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
}
#: SQL for a country's fixed length; others may end anywhere.
_IBAN_LENGTH = "(case " + " ".join(f"when substr(plain, 1, 2) in ({', '.join(repr(c) for c in names.split())}) then {n}" for n, names in _LENGTHS.items()) + " else least(34, length(plain)) end)"
#: Kinds whose matches may overlap and end early: all their ends are tested at
#: every start that is no part of a longer token, and the longest that holds counts.
RUNS = ("pan", "iban")
#: Fixed values, by kind: pattern, a cheap test that texts without a match fail,
#: a condition on the match ``v`` (SQL), score, and words nearby that raise it.
KINDS = {
    "email": (f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", "true", 0.8, "mail|contact|write|reply"),
    "ip": ("(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "[0-9]\\.[0-9]", f"v rlike '^{_OCTET}(\\\\.{_OCTET}){{3}}$'", 0.6, "ip|host|server|address|login"),
    "card": ("[0-9](?:[\\x20-]?[0-9])++", "[0-9](?:[\\x20-]?[0-9]){13}", "length(digits) between 14 and 19 and luhn = 0", 0.7, "card|visa|credit|payment|carte|tarjeta|karte"),
    "phone": ("\\+[0-9][\\x20().0-9-]+[0-9]", "\\+[0-9]", "length(digits) between 10 and 15", 0.6, "phone|tel|call|fax|mobile"),
    "pan": ("(?<![0-9])(?=([0-9](?:[\\x20-]?[0-9]){13,18}+[0-9]?))", "[0-9](?:[\\x20-]?[0-9]){13}", f"v rlike '{_PAN}' and length(digits) between 14 and 19 and luhn = 0", 0.7, "card|visa|credit|payment|carte|tarjeta|karte"),
    "iban": ("(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){8,30}+[A-Za-z0-9]?))", "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}", f"v rlike '{_IBAN}' and length(plain) = {_IBAN_LENGTH} and mod97 = 1", 0.8, "iban|bank|konto|account|compte|cuenta"),
    "ssn": ("(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "not v rlike '^(000|666|9)|-00-|-0000$'", 0.3, "ssn|social security|taxpayer"),
    "secret": ("(?i)\\b(?:api_?key|token|secret|passw(?:or)?d)\\b\\x20?[=:]\\x20?[\"']?[A-Za-z0-9_+/=-]{16,}+", "[=:]\\x20?[\"']?[A-Za-z0-9_+/=-]{16}", "true", 0.6, "config|export|auth|login"),
}
BASE = ("email", "ip", "card", "phone")
NEAR, LIFT, LEAST = 40, 0.25, 0.5
_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _confirmed(kind: str) -> str:
    """SQL for the spans of one kind from its matches ``m`` and the pieces ``p``."""
    _, _, holds, score, nearby = KINDS[kind]
    digits = "regexp_replace(s.v, '[^0-9]', '')"
    # Luhn: every second digit from the right doubled, nines cast out; the sum modulo 10.
    luhn = f"(aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> if(i % 2 = 1, if(int(c) > 4, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (a, d) -> a + d) % 10)"
    plain = "replace(s.v, ' ', '')"
    # Mod 97: country and check digits moved to the end, letters as two digits.
    mod97 = f"aggregate(filter(split(concat(substr({plain}, 5), substr({plain}, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))"
    holds = holds.replace("digits", digits).replace("luhn", luhn).replace("mod97", mod97).replace("plain", plain).replace("v rlike", "s.v rlike")
    # Each match's start: lengths are summed in runs of 256 and over the runs, as one
    # sum over all would copy its list for every match.
    step = "length(z.__pii_p)" if kind in RUNS else "length(z.__pii_p) + length(z.__pii_m)"
    runs = f"""transform(sequence(0, (size(__pii_m) - 1) div 256), c -> aggregate(slice(arrays_zip(__pii_m, __pii_p), c * 256 + 1, least(256, size(__pii_m) - c * 256)),
        named_struct('pos', 0, 'out', cast(array() as array<struct<start:int,v:string>>)),
        (a, z) -> named_struct('pos', a.pos + {step}, 'out', concat(a.out, array(named_struct('start', a.pos + length(z.__pii_p), 'v', z.__pii_m))))))"""
    # The looking pattern of RUNS sees a text with one character before it.
    bases = f"aggregate(r, named_struct('pos', {-1 if kind in RUNS else 0}, 'out', cast(array() as array<int>)), (a, z) -> named_struct('pos', a.pos + z.pos, 'out', concat(a.out, array(a.pos))), a -> a.out)"
    placed = f"transform(array({runs}), r -> flatten(zip_with(r, {bases}, (z, b) -> transform(z.out, s -> named_struct('start', s.start + b, 'v', s.v)))))[0]"
    if kind in RUNS:
        ends = "transform(sequence(14, greatest(14, length(s.v))), e -> named_struct('start', s.start, 'v', substr(s.v, 1, e), 'after', substr(s.v, e + 1, 1)))"
        placed = f"filter(transform({placed}, s -> try_element_at(filter({ends}, s -> not s.after rlike '[A-Za-z0-9]' and {holds}), -1)), s -> s is not null)"
        holds = "true"
    kept = f"filter({placed}, s -> {holds})" if holds != "true" else placed
    # Four bytes a character: what stands before a span is found without a walk from the text's start.
    before = f"lower(decode(substring(__pii_wide, 4 * greatest(0, s.start - {NEAR}) + 1, 4 * least(s.start, {NEAR})), 'UTF-32'))"
    rated = f"least(1.0D, {score}D + if({before} rlike '(?:{nearby})', {LIFT}D, 0.0D))"
    spans = f"transform({kept}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.start + length(s.v), 'value', s.v, 'score', {rated}))"
    if kind not in BASE:
        spans = f"filter({spans}, s -> s.score >= {LEAST}D)"
    return f"if(size(__pii_m) = 0, cast(array() as array<{_SPAN}>), {spans})"


def with_spans(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """All columns of ``docs`` and ``spans``, array<struct<kind, start, end,
    value, score>> in code points, by start, then kind in the order of KINDS.

    Kinds outside BASE need a score of a half, which those of weak patterns
    reach only with a word nearby. Null and empty texts have no spans. No
    shuffle: each row by itself, so repeated rows give the same and an empty
    table gives itself; the work on a very long text grows with its length. A
    column named ``spans`` is replaced, any other name may occur.
    """
    own = [c for c in docs.columns if c != "spans"]
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("__pii_row"), F.coalesce("text", F.lit("")).alias("__pii_text"))
    found = found.withColumn("__pii_wide", F.expr("encode(__pii_text, 'UTF-32')"))
    none = "cast(array() as array<string>)"
    for kind in kinds:
        pattern, cheap = _quoted(KINDS[kind][0]), KINDS[kind][1]
        test = "contains(__pii_text, '@')" if cheap == "@" else f"__pii_text rlike {_quoted(cheap)}"
        whole, group = ("concat('\\n', __pii_text)", 1) if kind in RUNS else ("__pii_text", 0)
        found = found.withColumn("__pii_m", F.expr(f"if({test}, regexp_extract_all({whole}, {pattern}, {group}), {none})"))
        found = found.withColumn("__pii_p", F.expr(f"if(size(__pii_m) > 0, split({whole}, {pattern}, -1), {none})"))
        found = found.withColumn(f"__pii_{kind}", F.expr(_confirmed(kind))).drop("__pii_m", "__pii_p")
    if "pan" in kinds and "card" in kinds:  # card numbers inside longer runs of digits; the others are cards already
        found = found.withColumn("__pii_pan", F.expr("filter(__pii_pan, s -> not exists(__pii_card, c -> c.start < s.end and s.start < c.end))"))
    ranks = ", ".join(f"'{k}'" for k in kinds)
    all_spans = f"flatten(array({', '.join(f'__pii_{k}' for k in kinds)}))"
    rank = lambda x: f"array_position(array({ranks}), {x}.kind)"
    order = f"case when x.start < y.start then -1 when x.start > y.start then 1 else int(sign({rank('x')} - {rank('y')})) end"
    ordered = F.expr(f"array_sort({all_spans}, (x, y) -> {order})")
    return found.select("__pii_row.*", ordered.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str = "text", spans: str = "spans") -> Column:
    """``text`` with every span replaced by its kind; overlaps become one mark."""
    # The pieces to keep and their marks are listed first, then cut from the text
    # at four bytes a character, so no piece costs a walk from its start.
    listed = f"""aggregate({spans}, named_struct('pos', 0, 'out', cast(array() as array<struct<from:int,upto:int,mark:string>>)),
        (a, s) -> case when s.end <= a.pos then a
            when s.start < a.pos then named_struct('pos', s.end, 'out', a.out)
            else named_struct('pos', s.end, 'out', concat(a.out, array(named_struct('from', a.pos, 'upto', s.start, 'mark', concat('[', upper(s.kind), ']'))))) end,
        a -> concat(a.out, array(named_struct('from', a.pos, 'upto', length({text}), 'mark', ''))))"""
    cut = "concat(decode(substring(wide, 4 * x.from + 1, 4 * (x.upto - x.from)), 'UTF-32'), x.mark)"
    return F.expr(f"if(size({spans}) = 0, {text}, transform(array(encode({text}, 'UTF-32')), wide -> array_join(transform({listed}, x -> {cut}), ''))[0])")
