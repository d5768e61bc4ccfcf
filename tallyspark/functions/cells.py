"""Column helpers for dirty cells: ids, dates, timestamps, money, transfer references. Null where a cell can't be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.schemas import FEE_BP, GST_PERCENT


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without white space of any Unicode kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def normalize_id(c: Column | str) -> Column:
    return F.lower(trim_all(c))


def optional_id(c: Column | str) -> Column:
    """An empty cell is null."""
    return F.nullif(normalize_id(c), F.lit(""))


def normalize_date(c: Column | str) -> Column:
    """DD/MM/YYYY or YYYY-MM-DD; an impossible date is null too."""
    t = trim_all(c)
    return F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("dd/MM/yyyy")))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))


def normalize_timestamp(c: Column | str) -> Column:
    """Strictly YYYY-MM-DDTHH:MM:SSZ."""
    t = trim_all(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def _rupees(c: Column | str, shape: str) -> Column:
    t = trim_all(c)
    body = F.regexp_replace(F.regexp_replace(t, "^-", ""), ",", "")
    digits = F.concat(F.substring_index(body, ".", 1), F.rpad(F.substring(F.regexp_extract(body, r"\.(\d*)", 1), 1, 2), 2, "0"))
    paise = digits.try_cast("bigint")
    return F.when(t == "", F.lit(0).cast("bigint")).when(body.rlike(shape), F.when(t.startswith("-"), -paise).otherwise(paise))


def parse_paise(c: Column | str) -> Column:
    """A rupee amount, commas anywhere, as paise; digits past the second decimal are cut off. Empty is 0."""
    return _rupees(c, r"^\d+(\.\d*)?$")


def parse_indian_rupees(c: Column | str) -> Column:
    """As parse_paise, but more than two decimals can't be read."""
    return _rupees(c, r"^\d+(\.\d{1,2})?$")


def parse_integer_paise(c: Column | str) -> Column:
    t = trim_all(c)
    return F.when(t.rlike(r"^-?\d+$"), t.try_cast("bigint"))


#: The statement's description formats, tried in this order.
DESCRIPTION_FORMATS = (
    ("RAZORPAY_SETTLEMENT", r"^RAZORPAY SETTLEMENT (\d{12})$"),
    ("NEFT_CR", r"^NEFT CR-(\d{12})-RAZORPAY SOFTWARE PVT LTD$"),
    ("IMPS", r"^IMPS/(\d{12})/RAZORPAYSOFT$"),
)


def extract_utr(c: Column | str) -> Column:
    """struct(utr, format): a known description format, else any run of exactly 12 digits, else null."""
    t = trim_all(c)
    found = F.when(t.rlike(r"(?<!\d)\d{12}(?!\d)"), F.struct(F.regexp_extract(t, r"(?<!\d)(\d{12})(?!\d)", 1).alias("utr"), F.lit("UNKNOWN_FORMAT").alias("format")))
    for name, pattern in reversed(DESCRIPTION_FORMATS):
        found = F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).alias("utr"), F.lit(name).alias("format"))).otherwise(found)
    return found


def format_indian_rupees(c: Column | str) -> Column:
    """Paise as rupees with Indian grouping: 12453000 is 1,24,530.00."""
    paise = F.abs(col(c))
    whole = F.regexp_replace(div(paise, 100).cast("string"), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    return F.concat(F.when(col(c) < 0, "-").otherwise(""), whole, F.lit("."), F.lpad((paise % 100).cast("string"), 2, "0"))


def slash_date(c: Column | str) -> Column:
    return F.date_format(col(c), "dd/MM/yyyy")


def iso_date(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def div(a: Column, b: int) -> Column:
    """Whole-number division, towards zero."""
    return F.call_function("div", a, F.lit(b))


def slab_bp(method: Column | str) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, bp in FEE_BP.items():
        out = out.when(col(method) == name, F.lit(bp))
    return out.otherwise(F.when(col(method).isNotNull(), F.raise_error(F.concat(F.lit("unknown payment method: "), col(method))).cast("int")))


def expected_fee(amount: Column | str, method: Column | str) -> Column:
    """The published slab's fee, half up, in paise; an unknown method is an error, no method no fee."""
    return div(col(amount) * slab_bp(method).cast("bigint") + F.lit(5000).cast("bigint"), 10_000)


def expected_tax(fee: Column | str) -> Column:
    return div(col(fee) * GST_PERCENT + 50, 100)


def entity_key(kind: Column | str, id_: Column | str) -> Column:
    return F.concat_ws(":", kind, id_)


def fnv1a32(c: Column | str) -> Column:
    """FNV-1a, 32 bits, as 8 hex digits, over the characters of an ASCII text."""
    letters = F.filter(F.split(col(c), ""), lambda x: x != "")
    number = F.aggregate(letters, F.lit(2166136261).cast("bigint"), lambda h, x: h.bitwiseXOR(F.ascii(x).cast("bigint")) * F.lit(16777619).cast("bigint") % F.lit(4294967296).cast("bigint"))
    return F.lower(F.lpad(F.hex(number), 8, "0"))


def residue_id(keys: Column | str) -> Column:
    """A case's short id from the array of its entity keys. 32 bits: cases must be checked for collisions."""
    return F.concat(F.lit("res_"), fnv1a32(F.array_join(F.array_sort(col(keys)), "|")))
