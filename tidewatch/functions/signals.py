"""Row signals as Column expressions: severity, entropy, base64, addresses, normal forms, stages."""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import constants as K


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as a chain of conditions."""
    out = reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), None))
    return out.otherwise(F.lit(default))


def any_of(text: Column, words: list[str]) -> Column:
    """Whether any word is a literal substring; null counts as no."""
    return F.coalesce(reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False)), F.lit(False))


def clean(c: Column) -> Column:
    """Empty text and the words that stand for null become null."""
    return F.when(F.lower(F.trim(c)).isin("", "none", "nan", "null"), None).otherwise(F.trim(c))


def severity(code: Column) -> Column:
    return F.when(code.isin(K.HIGH_CODES), "high").when(code.isin(K.MEDIUM_CODES), "medium").otherwise("low")


def priority(code: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, codes in K.PRIORITY_CODES.items():
        chain = chain.when(code.isin(codes), name)
    return chain.otherwise("low")


def event_uid(*parts: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row; inside lambdas an inlined expression would be repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rounded(value: Column, digits: int = 6) -> Column:
    """To so many digits; what is within a millionth of a half counts as a half, whichever way sums of doubles erred."""
    return F.floor(value * 10.0**digits + 0.500001) / 10.0**digits


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of all characters, to 3 digits.

    Each different character is taken once, and counted by how much shorter the text is without it.
    """
    size = F.length(text)
    different = F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    bits = F.aggregate(different, F.lit(0.0), lambda acc, c: acc + let((size - F.length(F.replace(text, c, F.lit("")))) / size, lambda p: -p * F.log2(p)))
    return F.when(F.coalesce(size, F.lit(0)) == 0, 0.0).otherwise(F.bround(bits, 3))


def high_entropy(text: Column, bits: Column) -> Column:
    n = F.length(text)
    return F.coalesce((n >= 20) & (bits > 4.5 + F.least(F.lit(1.5), n / 500)), F.lit(False))


def base64_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.BASE64_RUN), F.lit(0))


def base64_preview(text: Column) -> Column:
    """The first 80 characters of the first run that decodes to more than 4 as UTF-16LE."""
    decoded = F.transform(base64_runs(text), lambda m: F.trim(F.decode(F.unbase64(m), "UTF-16LE")))
    return F.substring(F.get(F.filter(decoded, lambda d: F.length(d) > 4), F.lit(0)), 1, 80)


def encoded_flag(text: Column) -> Column:
    # Words that mark an encoded command.
    words = ["-enc ", "-encodedcommand", " -e ", "-ec ", "frombase64string", "[convert]::frombase64", "::frombase64"]
    return any_of(F.lower(text), words)


def download_flag(text: Column) -> Column:
    return any_of(F.lower(text), ["http://", "https://"])


def external_address(ip: Column) -> Column:
    return F.coalesce((ip != "") & ~F.lower(ip).rlike(K.PRIVATE_ADDRESS), F.lit(False))


def suspicious_chain(parent: Column) -> Column:
    return F.coalesce((parent != "") & ~F.lower(parent).isin(K.BENIGN_PARENTS), F.lit(False))


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^\\/]*)$", 1))


def registry_path(path: Column) -> Column:
    low = F.lower(path)
    return F.regexp_replace(F.regexp_replace(low, r"^\\registry\\machine\\", r"hklm\\"), r"^\\registry\\user\\", r"hkcu\\")


def normal_command(text: Column, most: int = 100) -> Column:
    """Lower case without backticks, a payload spaced out after an encoding flag joined again, long hex runs as [HEX], single
    blanks, the first ``most`` characters."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "`", "")
    payload = F.regexp_extract(out, r"(-enc|-e|-encoded\w+)\s+([a-z0-9+/= ]{10,})", 2)
    out = F.when(payload != "", F.replace(out, payload, F.regexp_replace(payload, " ", ""))).otherwise(out)
    out = F.regexp_replace(out, r"[0-9a-f]{20,}", "[HEX]")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def parse_time(text: Column) -> Column:
    """ISO text with up to 7 fractional digits, an optional Z or offset; null words give null."""
    short = F.regexp_replace(clean(text), r"(\.\d{6})\d+", "$1")
    return F.try_to_timestamp(F.regexp_replace(short, " ", "T"))


def stage_rank(stage: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, K.STAGES)), stage) - 1, F.lit(0)).cast("int")


def promote(a: Column, b: Column) -> Column:
    return F.when(stage_rank(b) > stage_rank(a), b).otherwise(a)


def description(code: str = "event_code") -> Column:
    """What an event did, in words."""
    c = F.col(code)
    name = lambda x, other: F.coalesce(F.col(x), F.lit(other))
    return (
        F.when(c == 1, F.format_string("%s started %s", name("parent_image", "unknown"), name("image", "unknown")))
        .when(c == 3, F.format_string("%s connected to %s:%s", name("image", "unknown"), name("dst_ip", "?"), name("dst_port", "?")))
        .when(c == 11, F.format_string("%s wrote %s", name("image", "unknown"), name("file_path", "a file")))
        .when(c.isin(12, 13, 14), F.format_string("%s changed %s", name("image", "unknown"), name("reg_key", "a key")))
        .when(c == 22, F.format_string("%s resolved a name", name("image", "unknown")))
        .otherwise(F.format_string("%s caused event %s", name("image", "unknown"), c.cast("string")))
    )


def _filled(text: str, names: dict[str, Column]) -> Column:
    """A template with its ``{columns}`` filled in."""
    parts = re.split(r"{(\w+)}", text)
    return F.concat(*[names[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def event_text(events: DataFrame) -> DataFrame:
    """Adds ``text``, what each event did by its code; registry writes by the words in their key. Null for codes without a text."""
    have = lambda name, other: F.coalesce(F.col(name), F.lit(other)) if name in events.columns else F.lit(other)
    names = {"image": have("image", "Unknown process"), "key": F.lower(F.coalesce(have("reg_key", None).cast("string"), have("file_path", None).cast("string"), F.lit("?")))}
    names |= {c: have(c, "?") for c in ("dst_ip", "dst_port", "file_path", "reg_key", "image_loaded", "dns_query")}
    code = F.col("event_code")
    parent = F.when(have("parent_image", "") != "", F.concat(F.lit(" (parent: "), have("parent_image", ""), F.lit(")"))).otherwise("")
    out = F.when(code == 1, F.concat(names["image"], F.lit(" executed"), parent))
    for words, text in K.REGISTRY_TEXTS:
        out = out.when((code == 13) & any_of(names["key"], words), _filled(text, names))
    for n, text in K.EVENT_TEXTS.items():
        out = out.when(code == n, _filled(text, names))
    return events.withColumn("text", out)
