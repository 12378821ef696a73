"""Reversible masks: labels in the text, encrypted originals in an envelope column."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import base64url, from_base64url, hmac_sha256

LIFETIME = 300
SYSTEM_INFO, REQUEST_INFO = b"veilframe/sys", b"veilframe/v1"


def system_key(master: bytes, system: str) -> bytes:
    """The key of a system: one block of HKDF-Expand under the master key."""
    return hmac.new(master, system.encode() + SYSTEM_INFO + b"\1", hashlib.sha256).digest()


def request_key(key: bytes, salt: Column) -> Column:
    return hmac_sha256(key, F.concat(salt, F.lit(bytearray(REQUEST_INFO + b"\1"))))


def _nonce(i: Column) -> Column:
    return F.unhex(F.lpad(F.hex(i.cast("long")), 24, "0"))


def _aad(payload_id: Column, ty: Column, i: Column, expires: Column, label: Column) -> Column:
    return F.concat_ws("|", payload_id, ty, i.cast("string"), expires.cast("string"), label)


def seal_df(masked: DataFrame, key: bytes, irreversible: tuple[str, ...] = (), payload_id: Column | None = None) -> DataFrame:
    """masked(text, spans, salt binary, now long, ...) in token mode -> with envelope: v1.<salt>.<expiry>.<records>.

    A record is index:kind:label:ciphertext, with index the place among all spans; irreversible kinds have none. Texts
    without spans have no envelope. Salts are an input, so that retries give the same result.
    """
    pid = F.lit("") if payload_id is None else payload_id
    d = masked.withColumns({"_key": request_key(key, F.col("salt")), "_expires": F.col("now") + LIFETIME})

    def record(s: Column, i: Column) -> Column:
        label = F.concat(F.lit("["), s["ty"], F.lit("_"), s["start_b"].cast("string"), F.lit("]"))
        value = F.substring("text", s["start"] + 1, s["end"] - s["start"]).cast("binary")
        sealed = F.aes_encrypt(value, F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _nonce(i), _aad(pid, s["ty"], i, F.col("_expires"), label))
        # Spark puts the nonce first; it follows from the index, so it is left out
        text = F.concat(i.cast("string"), F.lit(":"), s["ty"], F.lit(":"), base64url(label.cast("binary")), F.lit(":"), base64url(F.substring(sealed, F.lit(13), F.length(sealed))), F.lit(";"))
        return F.when(~s["ty"].isin(*irreversible) if irreversible else F.lit(True), text)

    records = F.array_join(F.filter(F.transform("spans", record), lambda r: r.isNotNull()), "")
    header = F.concat(F.lit("v1."), base64url(F.col("salt")), F.lit("."), F.col("_expires").cast("string"), F.lit("."), base64url(records.cast("binary")))
    return d.withColumn("envelope", F.when(F.size("spans") > 0, header)).drop("_key", "_expires")


def unmask_df(df: DataFrame, key: bytes, now: Column, payload_id: Column | None = None) -> DataFrame:
    """df(masked, envelope) -> with restored and error: labels are replaced in order by the decrypted originals.

    error: 'expired', 'malformed', 'label not found' or 'cannot open' (another system's key, or a changed envelope);
    restored is null then. A null envelope restores the text as it is.
    """
    pid = F.lit("") if payload_id is None else payload_id
    parts = F.split("envelope", r"\.")
    d = df.withColumns({"_salt": from_base64url(F.try_element_at(parts, F.lit(2))), "_expires": F.try_element_at(parts, F.lit(3)).try_cast("long"), "_records": from_base64url(F.try_element_at(parts, F.lit(4))).cast("string")})
    d = d.withColumn("_key", request_key(key, F.col("_salt")))

    def opened(r: Column) -> Column:
        f = F.split(r, ":")
        i, ty, label = f[0].try_cast("long"), f[1], from_base64url(f[2]).cast("string")
        sealed = F.concat(_nonce(i), from_base64url(f[3]))
        value = F.try_aes_decrypt(sealed, F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), _aad(pid, ty, i, F.col("_expires"), label)).cast("string")
        return F.struct(label.alias("label"), value.alias("value"))

    d = d.withColumn("_open", F.transform(F.filter(F.split("_records", ";"), lambda r: r != ""), opened))
    state = "struct<out:string,rest:string,error:string>"
    start = F.struct(F.lit("").alias("out"), F.col("masked").alias("rest"), F.lit(None).cast("string").alias("error")).cast(state)

    def step(a: Column, r: Column) -> Column:
        at = F.call_function("instr", a["rest"], r["label"])
        error = F.coalesce(a["error"], F.when(r["value"].isNull(), "cannot open"), F.when(at == 0, "label not found"))
        out = F.concat(a["out"], F.substring(a["rest"], F.lit(1), at - 1), F.coalesce(r["value"], F.lit("")))
        rest = F.substring(a["rest"], at + F.length(r["label"]), F.length(a["rest"]))
        return F.struct(F.when(error.isNull(), out).otherwise(a["out"]).alias("out"), F.when(error.isNull(), rest).otherwise(a["rest"]).alias("rest"), error.alias("error")).cast(state)

    folded = F.aggregate("_open", start, step)
    well_formed = (F.size(parts) == 4) & (parts[0] == "v1") & F.col("_expires").isNotNull()
    error = F.when(F.col("envelope").isNull(), F.lit(None)).when(~F.coalesce(well_formed, F.lit(False)), "malformed").when(now > F.col("_expires"), "expired").otherwise(folded["error"])
    d = d.withColumn("error", error.cast("string"))
    restored = F.when(F.col("envelope").isNull(), F.col("masked")).when(F.col("error").isNull(), F.concat(folded["out"], folded["rest"]))
    return d.withColumn("restored", restored).drop("_salt", "_expires", "_records", "_key", "_open")
