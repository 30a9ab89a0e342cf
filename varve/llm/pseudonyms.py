"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their format by a keyed
Feistel network, so equal values get equal pseudonyms in all documents and
different values never share one. The network runs on Z_a x Z_b: in turn each
half gains a keyed digest of the other, modulo its size, which is a permutation
of a * b values for any a and b; so no value leaves its format.

- card numbers of 13 to 19 digits that pass the Luhn test; the check digit is made anew
- IPv4 addresses
- telephone numbers of ten digits, with or without a country code, which stays
- US social security numbers of an issued form
- dates of 1900 to 2099, as YYYY-MM-DD, DD/MM/YYYY or DD.MM.YYYY (a month over 12 makes it MM/DD/YYYY)

Mail addresses and hexadecimal secrets are no numbers; they become keyed
digests of their form. What fails its test stays as it is.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import documents

_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
_SECRET = r"(?<![\p{L}\p{N}])(?=[a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])"
_IP = r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)"
_DATE = r"(?<![\p{L}\p{N}\-/.])(?:\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4})(?!(?!T\d)[\p{L}\p{N}]|[\-/.]\d)"  # a time may follow, as in 2020-01-02T03:04
_PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}([.\-])\d{3}\2\d{4})(?![\p{L}\p{N}]|-\d)"
_SSN = r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"
_CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}([ \-])\d{4}\3\d{4}\3\d{4}|\d{4}([ \-])\d{6}\4\d{5})(?![\p{L}\p{N}])"
PATTERN = "|".join((_MAIL, _SECRET, _IP, _DATE, _PHONE, _SSN, _CARD))

_ROUNDS = 9


def _text(pattern: str) -> str:
    return "r'" + pattern + "'"


def feistel(x: str, a: int | str, b: int | str, tweak: str) -> str:
    """SQL for the keyed permutation of x, from 0 to a * b - 1; {key} stands for the key."""
    digest = lambda half, i: f"CAST(conv(substr(sha2(concat({{key}}, ':{tweak}:', {i}, ':', {half}), 256), 1, 15), 16, 10) AS BIGINT)"
    return (
        f"aggregate(sequence(0, {_ROUNDS}), named_struct('l', CAST({x} AS BIGINT) DIV {b}, 'r', CAST({x} AS BIGINT) % {b}), "
        f"(s, i) -> IF(i % 2 = 0, named_struct('l', (s.l + {digest('s.r', 'i')}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {digest('s.l', 'i')}) % {b})), s -> s.l * {b} + s.r)"
    )


def luhn(digits: str) -> str:
    """SQL for the Luhn sum of a string of digits."""
    value = f"CAST(substr({digits}, length({digits}) - i, 1) AS INT)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + IF(i % 2 = 0, {value}, 2 * {value} - IF({value} > 4, 9, 0)))"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with a value under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _dress(new: str) -> str:
    """SQL for the string m with its digits replaced in turn by those of ``new``."""
    return f"array_join(transform(sequence(1, length(m)), k -> IF(substr(m, k, 1) BETWEEN '0' AND '9', substr({new}, length(regexp_replace(substr(m, 1, k), '[^0-9]', '')), 1), substr(m, k, 1))), '')"


def replacement() -> str:
    """SQL for what stands in for the match m."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    secret = "substr(concat(sha2(concat({key}, ':secret:', m), 512), sha2(concat({key}, ':more:', m), 512)), 1, length(m))"
    letters = lambda what, tag, n: f"translate(substr(sha2(concat({{key}}, ':{tag}:', {what}), 256), 1, {n}), '0123456789', 'ghijklmnop')"
    host = "substring_index(m, '@', -1)"
    mail = f"concat({letters('m', 'mail', 12)}, '@', {letters(host, 'host', 8)}, '.example')"

    octets = "transform(split(m, '[.]'), o -> CAST(o AS BIGINT))"
    number = "o[0] * 16777216 + o[1] * 65536 + o[2] * 256 + o[3]"
    address = _let(feistel(number, 65536, 65536, "ip"), "v", "concat_ws('.', v DIV 16777216, v DIV 65536 % 256, v DIV 256 % 256, v % 256)")
    ip = _let(octets, "o", f"IF(forall(o, x -> x < 256), {address}, m)")

    shift = lambda y, mth, d: f"datediff(date_add(make_date({y}, {mth}, 1), {d} - 1), DATE'1900-01-01')"
    real = lambda y, mth, d: f"({y} BETWEEN 1900 AND 2099 AND {mth} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= day(last_day(make_date({y}, IF({mth} BETWEEN 1 AND 12, {mth}, 1), 1))))"
    # 73049 days from 1900 to 2099 are 17 * 4297
    moved = lambda y, mth, d, form: _let(feistel(shift(y, mth, d), 17, 4297, "date"), "v", f"date_format(date_add(DATE'1900-01-01', CAST(v AS INT)), {form})")
    part = lambda at, n: f"CAST(substr(m, {at}, {n}) AS INT)"
    iso = f"CASE WHEN {real(part(1, 4), part(6, 2), part(9, 2))} THEN {moved(part(1, 4), part(6, 2), part(9, 2), chr(39) + 'yyyy-MM-dd' + chr(39))} ELSE m END"
    mark = "substr(m, 3, 1)"
    local = (
        f"CASE WHEN {real(part(7, 4), part(4, 2), part(1, 2))} THEN {moved(part(7, 4), part(4, 2), part(1, 2), f'concat({chr(39)}dd{chr(39)}, {mark}, {chr(39)}MM{chr(39)}, {mark}, {chr(39)}yyyy{chr(39)})')} "
        f"WHEN {real(part(7, 4), part(1, 2), part(4, 2))} THEN {moved(part(7, 4), part(1, 2), part(4, 2), f'concat({chr(39)}MM{chr(39)}, {mark}, {chr(39)}dd{chr(39)}, {mark}, {chr(39)}yyyy{chr(39)})')} ELSE m END"
    )

    body = "CAST(right(d, 10) AS BIGINT)"
    phone = _let(digits, "d", _let(f"concat(left(d, length(d) - 10), lpad(CAST({feistel(body, 100000, 100000, 'phone')} AS STRING), 10, '0'))", "n", _dress("n")))

    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    issued = f"({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} >= 1 AND {serial} >= 1)"
    rank = f"((({area} - 1 - IF({area} > 666, 1, 0)) * 99 + {group} - 1) * 9999L + {serial} - 1)"
    back = "format_string('%03d-%02d-%04d', v DIV 989901 + 1 + IF(v DIV 989901 >= 665, 1, 0), v DIV 9999 % 99 + 1, v % 9999 + 1)"
    ssn = f"IF({issued}, {_let(feistel(rank, 898 * 99, 9999, 'ssn'), 'v', back)}, m)"

    # the payload is all but the check digit; halves of length (n - 1) / 2 each, rounded either way
    payload = "CAST(left(d, length(d) - 1) AS BIGINT)"
    ten = lambda n: f"CAST(rpad('1', 1 + {n}, '0') AS BIGINT)"
    permuted = feistel(payload, ten("length(d) DIV 2"), ten("(length(d) - 1) DIV 2"), "card")
    checked = _let(f"lpad(CAST({permuted} AS STRING), length(d) - 1, '0')", "p", _let(f"concat(p, CAST((10 - {luhn('concat(p, ' + chr(39) + '0' + chr(39) + ')')} % 10) % 10 AS STRING))", "n", _dress("n")))
    card = _let(digits, "d", f"IF({luhn('d')} % 10 = 0, {checked}, m)")

    return f"""CASE
  WHEN contains(m, '@') THEN {mail}
  WHEN m RLIKE '^[0-9a-fA-F]{{32,}}$' THEN {secret}
  WHEN m RLIKE '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {ip}
  WHEN m RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {iso}
  WHEN m RLIKE '^[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}}$' THEN {local}
  WHEN m RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {ssn}
  WHEN m RLIKE '^[+(]' OR m RLIKE '^[0-9]{{3}}([.-])[0-9]{{3}}[.-][0-9]{{4}}$' THEN {phone}
  ELSE {card} END"""


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with text pseudonymised, n_chars (where it is a column) made anew, and n_replaced, how many values changed.

    A null text stays null and an empty one empty, with none replaced; a text
    of any length is searched as a whole; an empty table stays empty; all
    other columns and repeated rows stay as they are. Columns of ``docs`` named
    n_replaced, _pii_found or _pii_new are replaced. The key is a literal of
    the plan: set spark.sql.redaction.string.regex to keep it out of logs.
    """
    own = "'" + key.replace("\\", "\\\\").replace("'", "\\'") + "'"
    made = replacement().replace("{{", "\x01").replace("}}", "\x02").replace("{key}", own).replace("\x01", "{").replace("\x02", "}")
    found = docs.withColumn("_pii_found", F.expr(f"regexp_extract_all(coalesce(text, ''), {_text(PATTERN)}, 0)"))
    new = found.withColumn("_pii_new", F.expr(f"IF(size(_pii_found) = 0, _pii_found, transform(_pii_found, m -> {made}))"))
    # text between the matches and the matches' stand-ins, in turn
    text = F.expr(f"IF(size(_pii_found) = 0, text, array_join(flatten(zip_with(split(text, {_text(PATTERN)}, -1), _pii_new, (gap, v) -> array(gap, coalesce(v, '')))), ''))")
    out = new.withColumn("text", text).withColumn("n_replaced", F.expr("size(filter(zip_with(_pii_found, _pii_new, (a, b) -> a <> b), x -> x))"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("_pii_found", "_pii_new")


#: The key of the registered query and of the pipeline; a real run passes its own.
DEMO_KEY = "varve demonstration key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced. Nulls, repeats, long texts and empty tables: see pseudonymise()."""
    return pseudonymise(documents(spark, sf_dir), DEMO_KEY).select("doc_id", "text", "n_replaced")


QUERIES = {"op5_pseudonyms": op5_pseudonyms}
SQL: dict[str, str] = {}
