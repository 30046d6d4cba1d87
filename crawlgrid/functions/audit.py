"""F10 package checksum and F17 signed-request audit (HMAC-SHA256), native.

HMAC is built from Spark's own ``sha2``: the key is padded to the 64-byte
block, XOR-ed with the inner / outer pads in 4-byte words (hex ↔ long), and
hashed twice. The pads are computed once per key row (a broadcast-sized key
table), never per request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64


def package_checksum(content) -> Column:
    """sha1 hex of the package bytes."""
    c = F.col(content) if isinstance(content, str) else content
    return F.sha1(c.cast("binary"))


def hmac_pads(secret: Column) -> tuple[Column, Column]:
    """(inner, outer) padded keys as hex strings for a secret string column."""
    kb = F.encode(secret, "UTF-8")
    k = F.when(F.octet_length(kb) > BLOCK, F.unhex(F.sha2(kb, 256))).otherwise(kb)
    khex = F.rpad(F.hex(k), BLOCK * 2, "0")

    def xor(pad: int) -> Column:
        word = int(format(pad, "02x") * 4, 16)
        return F.array_join(F.transform(
            F.sequence(F.lit(0), F.lit(BLOCK // 4 - 1)),
            lambda i: F.lpad(F.hex(F.conv(F.substring(khex, i * 8 + 1, 8), 16, 10).cast("long")
                                   .bitwiseXOR(F.lit(word))), 8, "0")), "")
    return xor(0x36), xor(0x5C)


def hmac_sha256_hex(ipad_hex: Column, opad_hex: Column, message: Column) -> Column:
    inner = F.sha2(F.concat(F.unhex(ipad_hex), message), 256)
    return F.sha2(F.concat(F.unhex(opad_hex), F.unhex(inner)), 256)


def _quote(v: Column) -> Column:
    """Python ``quote(v, safe='/')`` from Java's form encoding."""
    e = F.url_encode(v)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def _unquote(v: Column) -> Column:
    """``+`` and valid escapes decoded; a ``%`` that begins none stays as it is."""
    return F.url_decode(F.regexp_replace(v, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_query(query: Column) -> Column:
    """Sorted ``key=quote(value)`` pairs joined by '&' (blank values kept)."""
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&", -1), lambda p: p != "")
    kv = F.transform(pairs, lambda p: F.struct(
        _unquote(F.substring_index(p, "=", 1)).alias("k"),
        F.when(F.instr(p, "=") > 0,
               _unquote(F.substring(p, F.instr(p, "=") + 1, 1 << 30))).otherwise(F.lit("")).alias("v")))
    srt = F.array_sort(kv)
    return F.array_join(F.transform(srt, lambda x: F.concat(x["k"], F.lit("="), _quote(x["v"]))), "&")


def request_audit(requests: DataFrame, user_keys: DataFrame) -> DataFrame:
    """classify signed requests: accepted, bad header, bad algorithm,
    unknown key, deleted key (disabled), bad digest.

    ``requests``: request_id, authorization, method, path, query, body (binary).
    """
    keys = user_keys.select(F.col("app_key").alias("_key"), F.col("enabled").alias("_enabled"),
                            *[c.alias(n) for c, n in zip(hmac_pads(F.col("app_secret")), ["_ipad", "_opad"])])
    parts = F.split(F.col("authorization"), " ", -1)
    r = requests.withColumn("_parts", parts).withColumn(
        "_key_in", F.when(F.size("_parts") == 3, F.get("_parts", 1)))
    j = r.join(keys, r._key_in == keys._key, "left")
    msg = F.concat(F.encode(F.concat_ws("\n", "method", "path", canonical_query(F.col("query")), F.lit("")), "UTF-8"),
                   F.coalesce(F.col("body"), F.lit(b"").cast("binary")))
    digest = hmac_sha256_hex(F.col("_ipad"), F.col("_opad"), msg)
    verdict = (F.when(F.size("_parts") != 3, "bad header")
               .when(F.get("_parts", 0) != "HMAC", "bad algorithm")
               .when(F.col("_key").isNull(), "unknown key")
               .when(~F.col("_enabled"), "deleted key")
               .when(digest != F.lower(F.get("_parts", 2)), "bad digest")
               .otherwise("accepted"))
    return j.select(*requests.columns, digest.alias("expected_digest"), verdict.alias("verdict"))
