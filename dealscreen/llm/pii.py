"""Personal data replaced by format-preserving Feistel pseudonyms; DataFrame / SQL functions only.

Validated values are permuted by a keyed Feistel network inside their own format, so a pseudonym is a valid value of the
same shape and equal values get equal pseudonyms in all documents (nothing is looked up or shuffled):

* card numbers (Luhn): first digit kept, other digits permuted, check digit recomputed
* IBANs (mod 97): country kept, digits and letters permuted in their places, check digits recomputed
* social security numbers (valid area, group, serial): permuted within the valid numbers
* calendar dates 1900-2099 (y-m-d, y/m/d, d.m.y, m/d/y, else d/m/y): permuted within those dates
* IPv4 addresses (octets to 255): permuted within 32 bits
* phone numbers (8 to 15 digits, with country code or national punctuation): the national digits are permuted
* e-mail addresses: the local part, letters and digits in their places; the domain is kept
* hexadecimal secrets of 32 to 128 digits with at least one figure: hex digits

Text that only looks like one of them but fails validation is left alone, as is everything else. All formats are
permuted one to one, so different values keep different pseudonyms.

Defined cases: null text stays null, empty text empty; rows are independent, so repeated rows and ids don't matter; the
key is a parameter (``key``), the same for all documents that shall stay linked. Without it the session's
``dealscreen.pii.key`` is taken, and where that is unset too, the public ``KEY``, with which anyone can undo the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dealscreen.llm.common import read

KEY, KEY_SETTING, ROUNDS = "dealscreen-pseudonyms", "dealscreen.pii.key", 10

_FIRST_DAY, _DAYS = "DATE'1900-01-01'", (17, 4297)  # 17 * 4297 days: 1900-01-01 to 2099-12-31

#: Shapes, tried in this order at every start of a word.
SHAPES = {
    "email": r"[\p{L}\p{N}._%+\-]{1,64}@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": r"(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\.\d)",
    "phone": r"\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|\+\d{1,3}[ \-]?\(?\d{1,4}\)?(?:[ \-]?\d{2,4}){2,3}"
             r"|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}",
    "card": r"\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19}",
    "secret": r"(?=[a-f]*\d)[0-9a-f]{32,128}|(?=[A-F]*\d)[0-9A-F]{32,128}",
}
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERN = _EDGE + "(?:" + "|".join(f"(?:{p}){_END}" for p in SHAPES.values()) + ")"


def _let(var: str, value: str, body: str) -> str:
    """SQL: body with var bound to value, evaluated once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code(c: str) -> str:
    """SQL: place of an ASCII letter or digit in its class."""
    return (f"CAST(CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'a' AND 'z' "
            f"THEN ascii({c}) - 97 WHEN {c} BETWEEN 'A' AND 'Z' THEN ascii({c}) - 65 ELSE 0 END AS INT)")


def _radix(c: str) -> str:
    return (f"CASE WHEN {c} BETWEEN '0' AND '9' THEN 10 WHEN {c} BETWEEN 'a' AND 'z' OR {c} BETWEEN 'A' AND 'Z' "
            f"THEN 26 ELSE 1 END")


def _decode(c: str, code: str) -> str:
    return (f"CASE WHEN {c} BETWEEN '0' AND '9' THEN chr({code} + 48) WHEN {c} BETWEEN 'a' AND 'z' "
            f"THEN chr({code} + 97) WHEN {c} BETWEEN 'A' AND 'Z' THEN chr({code} + 65) ELSE {c} END")


def permuted_text(value: str, kind: str, key: str, hexadecimal: bool = False) -> str:
    """SQL: the value with the characters of each half shifted, in turns, by a keyed function of the other half.

    A character stays in its class (digit, lower, upper; hex digits are one class), others stay as they are; the
    classes and other characters are part of the key, so every format has its own permutation.
    """
    if hexadecimal:
        code, radix = (lambda c: f"CAST(conv({c}, 16, 10) AS INT)"), (lambda c: "16")
        shape = "if(v = lower(v), 'x', 'X') || length(v)"
        text = "array_join(transform(out, x -> if(v = lower(v), lower(hex(x)), hex(x))), '')"
    else:
        code, radix = _code, _radix
        shape = "regexp_replace(regexp_replace(regexp_replace(v, '[0-9]', '9'), '[a-z]', 'a'), '[A-Z]', 'A')"
        text = "array_join(transform(out, (x, i) -> " + _let("c", "c0[i]", _decode("c", "x")) + "), '')"
    half = "(size(c0) div 2)"
    shifted = ("transform({own}, (x, j) -> CAST((x + CAST(conv(substring(h, (j % 32) * 4 + 1, 4), 16, 10) AS INT)) "
               "% r0[j + {base}] AS INT))")
    step = _let(
        "h", f"sha2(concat_ws('|', {_text(key)}, '{kind}', f0, i, array_join(if(i % 2 = 0, s.b, s.a), ',')), 512)",
        f"if(i % 2 = 0, named_struct('a', {shifted.format(own='s.a', base='0')}, 'b', s.b), "
        f"named_struct('a', s.a, 'b', {shifted.format(own='s.b', base=half)}))")
    codes = f"transform(c0, c -> {code('c')})"
    rounds = (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', slice({codes}, 1, {half}), "
              f"'b', slice({codes}, {half} + 1, size(c0))), (s, i) -> {step}, s -> concat(s.a, s.b))")
    body = _let("out", rounds, text)
    body = _let("r0", f"transform(c0, c -> CAST({radix('c')} AS INT))", _let("f0", shape, body))
    # Every character as one element, also beyond the basic plane.
    chars = "regexp_extract_all(v, '(?s).', 0)"
    return _let("v", value, f"if(v = '', v, {_let('c0', chars, body)})")


def permuted_number(value: str, a: int, b: int, kind: str, key: str) -> str:
    """SQL: a keyed permutation of the numbers below a * b (Feistel over Z_a x Z_b)."""
    step = _let("h", f"CAST(conv(substring(sha2(concat_ws('|', {_text(key)}, '{kind}', i, if(i % 2 = 0, s.b, s.a)), "
                     f"256), 1, 15), 16, 10) AS BIGINT)",
                f"if(i % 2 = 0, named_struct('a', (s.a + h % {a}L) % {a}L, 'b', s.b), "
                f"named_struct('a', s.a, 'b', (s.b + h % {b}L) % {b}L))")
    return _let("v", f"CAST({value} AS BIGINT)",
                f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', v div {b}L, 'b', v % {b}L), "
                f"(s, i) -> {step}, s -> s.a * {b}L + s.b)")


def _relaid(template: str, chars: str) -> str:
    """SQL: the letters and digits of the template replaced, in order, by those of chars; the rest stays."""
    return (f"aggregate(regexp_extract_all({template}, '(?s).', 0), named_struct('t', '', 'i', 1), (s, c) -> "
            f"if(c RLIKE '[0-9A-Za-z]', named_struct('t', s.t || substring({chars}, s.i, 1), 'i', s.i + 1), "
            f"named_struct('t', s.t || c, 'i', s.i)), s -> s.t)")


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of the digits, the last one counting once."""
    return (f"aggregate(transform(regexp_extract_all(reverse({digits}), '.', 0), (c, i) -> "
            f"CAST(c AS INT) * (1 + i % 2) - if(i % 2 = 1 AND CAST(c AS INT) > 4, 9, 0)), 0, (s, x) -> s + x)")


def _mod97(text: str) -> str:
    """SQL: the text read as a number, letters as 10 to 35, modulo 97."""
    return (f"aggregate(regexp_extract_all({text}, '.', 0), 0, (s, c) -> CAST(if(c BETWEEN '0' AND '9', "
            f"(s * 10 + ascii(c) - 48) % 97, (s * 100 + ascii(c) - 55) % 97) AS INT))")


def _card(m: str, key: str) -> str:
    body = "substring(d, 1, 1) || " + permuted_text("substring(d, 2, length(d) - 2)", "card", key)
    fixed = _let("b", body, f"b || CAST((10 - {_luhn('(b || 0)')} % 10) % 10 AS STRING)")
    return _let("d", f"regexp_replace({m}, '[^0-9]', '')",
                f"if({_luhn('d')} % 10 = 0 AND d RLIKE '[1-9]', {_let('n', fixed, _relaid(m, 'n'))}, {m})")


def _iban(m: str, key: str) -> str:
    rest = permuted_text("substring(d, 5)", "iban", key)
    fixed = _let("b", rest, "substring(d, 1, 2) || lpad(CAST(98 - "
                 + _mod97("(b || substring(d, 1, 2) || '00')") + " AS STRING), 2, '0') || b")
    return _let("d", f"replace({m}, ' ', '')",
                f"if(length(d) BETWEEN 15 AND 34 AND {_mod97('(substring(d, 5) || substring(d, 1, 4))')} = 1, "
                f"{_let('n', fixed, _relaid(m, 'n'))}, {m})")


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"CAST(substring({m}, {i}, {n}) AS INT)" for i, n in ((1, 3), (5, 2), (8, 4)))
    rank = f"((({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1) * 9999 + {serial} - 1)"
    new = permuted_number(rank, 898 * 99, 9999, "ssn", key)
    place = "(n div 989901L)"  # 99 * 9999 numbers an area
    text = (f"lpad(CAST({place} + if({place} >= 665, 2, 1) AS STRING), 3, '0') || '-' || "
            f"lpad(CAST(n div 9999L % 99L + 1 AS STRING), 2, '0') || '-' || lpad(CAST(n % 9999L + 1 AS STRING), 4, '0')")
    return f"if({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {_let('n', new, text)}, {m})"


def _ip(m: str, key: str) -> str:
    octets = f"transform(split({m}, '[.]'), o -> CAST(o AS BIGINT))"
    new = permuted_number("(o[0] * 16777216L + o[1] * 65536L + o[2] * 256L + o[3])", 65536, 65536, "ip", key)
    text = "concat_ws('.', n div 16777216L, n div 65536L % 256L, n div 256L % 256L, n % 256L)"
    return _let("o", octets, f"if(forall(o, x -> x < 256), {_let('n', new, text)}, {m})")


def _date(m: str, key: str) -> str:
    """Dates are read by their layout; d/m/y only where m/d/y is no date, and then walked to such a day again."""
    def day(var: str) -> str:
        return f"date_add({_FIRST_DAY}, CAST({var} AS INT))"

    def moved(d: str) -> str:
        return permuted_number(f"datediff({d}, {_FIRST_DAY})", *_DAYS, "date", key)

    def valid(layout: str) -> str:
        return f"try_to_timestamp({m}, '{layout}')"

    out = f"CASE WHEN false THEN {m}"
    for layout in ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy"):
        date = f"CAST({valid(layout)} AS DATE)"
        out += (f" WHEN {m} RLIKE '^{layout.replace('yyyy', '[0-9]{4}').replace('MM', '[0-9]{2}').replace('dd', '[0-9]{2}').replace('.', '[.]')}$'"
                f" AND year({date}) BETWEEN 1900 AND 2099 THEN date_format({_let('n', moved(date), day('n'))}, '{layout}')")
    date = f"CAST({valid('dd/MM/yyyy')} AS DATE)"
    walked = (f"aggregate(sequence(1, 64), named_struct('d', {date}, 'ok', false), (w, k) -> if(w.ok, w, "
              + _let("q", _let("n", moved("w.d"), day("n")), "named_struct('d', q, 'ok', dayofmonth(q) > 12)")
              + "), w -> w.d)")
    out += (f" WHEN {m} LIKE '__/__/____' AND year({date}) BETWEEN 1900 AND 2099 THEN date_format({walked}, 'dd/MM/yyyy')")
    return out + f" ELSE {m} END"


def _phone(m: str, key: str) -> str:
    code = f"if({m} LIKE '+%', regexp_extract({m}, '^[+][0-9]{{1,3}}', 0), '')"
    rest = "substring(p, length(q) + 1)"
    digits = f"regexp_replace({rest}, '[^0-9]', '')"
    new = _let("n", permuted_text(digits, "phone", key), f"q || {_relaid(rest, 'n')}")
    return _let("p", m, _let("q", code, f"if(length(regexp_replace(p, '[^0-9]', '')) BETWEEN 8 AND 15, {new}, p)"))


def _email(m: str, key: str) -> str:
    return permuted_text(f"substring_index({m}, '@', 1)", "email", key) + f" || '@' || substring_index({m}, '@', -1)"


def pseudonym(m: str, key: str = KEY) -> str:
    """SQL: the pseudonym of a string matched by PATTERN, itself where validation fails."""
    make = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card,
            "secret": lambda m, key: permuted_text(m, "secret", key, hexadecimal=True)}
    cases = " ".join(f"WHEN {m} RLIKE {_text('^(?:' + p + ')$')} "
                     f"THEN {make[kind](m, key)}" for kind, p in SHAPES.items())
    return f"CASE {cases} ELSE {m} END"


def _interleaved(found: str, made: str) -> Column:
    """The pieces of text between the found strings, with the made ones in their places."""
    return F.expr(f"array_join(zip_with({found}, {made}, (p, t) -> concat(p, coalesce(t, ''))), '')")


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """row (the document, all columns), the new text and how many strings were replaced."""
    key = docs.sparkSession.conf.get(KEY_SETTING, KEY) if key is None else key
    pattern = F.lit(PATTERN)
    found = docs.select(F.struct("*").alias("row"), F.col(text).alias("old"),
                        F.regexp_extract_all(F.col(text), pattern, F.lit(0)).alias("found"))
    made = found.select("row", "old", "found", F.expr(f"transform(found, m -> {pseudonym('m', key)})").alias("made"))
    pieces = F.when(F.size("found") > 0, F.split("old", PATTERN, -1))
    return made.select("row", "old", "found", "made", pieces.alias("pieces")).select(
        "row", F.when(F.size("found") > 0, _interleaved("pieces", "made")).otherwise(F.col("old")).alias("new"),
        F.expr("CAST(coalesce(size(filter(zip_with(found, made, (x, y) -> x <> y), z -> z)), 0) AS BIGINT)").alias("replaced"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("new").alias("text"), F.col("replaced").alias("n_replaced"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: text replaced by its pseudonymised form, n_chars (if there) by its length."""
    out = pseudonymise(docs)
    own = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return out.select(*[own[c].alias(c) if c in own and (c != "n_chars" or dict(docs.dtypes)[c] == "bigint")
                        else F.col("row").getField(c).alias(c) for c in docs.columns])
