"""What a service in front of the engine needs: envelopes, status codes, authentication and health."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import canonical_request, hmac_sha256, same_digest
from .sessions import CLOCK_SKEW_S

#: HTTP status of each error code.
ARCHIVE_STATUS = {
    "OK": 200, "INVALID_ARGUMENT": 400, "INVALID_CURSOR": 400, "AUTH_REQUIRED": 401, "SIGNATURE_INVALID": 401, "TIMESTAMP_EXPIRED": 401, "OPERATOR_TOKEN_INVALID": 401,
    "DEVICE_DISABLED": 403, "COLLECTOR_DEVICE_MISMATCH": 403, "UPLOAD_DEVICE_MISMATCH": 403, "DEVICE_NOT_FOUND": 404, "UPLOAD_NOT_FOUND": 404, "ARCHIVE_NOT_FOUND": 404,
    "REQUEST_REPLAYED": 409, "UPLOAD_STATE_CONFLICT": 409, "CHUNK_CONTENT_CONFLICT": 409, "CHUNKS_INCOMPLETE": 409, "FILE_TOO_LARGE": 413, "CHUNK_TOO_LARGE": 413, "FILE_INTEGRITY_MISMATCH": 422,
    "UPLOAD_LIMIT_EXCEEDED": 429, "STORAGE_IO_ERROR": 500, "SERVICE_NOT_READY": 503, "MYSQL_UNAVAILABLE": 503, "REDIS_UNAVAILABLE": 503, "STORAGE_CAPACITY_EXCEEDED": 507,
}
SEARCH_STATUS = {
    "OK": 200, "INVALID_ARGUMENT": 400, "OPERATOR_TOKEN_INVALID": 401, "LOG_NOT_FOUND": 404, "ERROR_CODE_NOT_FOUND": 404, "INDEX_CORRUPTED": 500, "STORAGE_IO_ERROR": 500,
    "SEARCH_RPC_UNAVAILABLE": 502, "SERVICE_NOT_READY": 503, "MYSQL_UNAVAILABLE": 503, "SEARCH_RPC_TIMEOUT": 504,
}


def status(code: Column, table: dict[str, int], unknown: int = 500) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), code), F.lit(unknown))


def envelope(rows: DataFrame, request_id: str, code: str = "OK", message: str = "ok") -> DataFrame:
    """Each row as the data of a JSON reply."""
    return rows.select(F.to_json(F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(request_id).alias("request_id"), F.struct(*rows.columns).alias("data")), {"ignoreNullFields": "false"}).alias("reply"))


def token_ok(given: str | None, expected: str) -> bool:
    """Bearer token in constant time."""
    return hmac.compare_digest(hashlib.sha256((given or "").encode()).digest(), hashlib.sha256(f"Bearer {expected}".encode()).digest())


def authenticate(requests: DataFrame, devices: DataFrame, now_s: int) -> DataFrame:
    """requests with auth_code by precedence: missing headers, clock, unknown or disabled device, signature. Replays are found in state."""
    d = devices.select("device_id", F.col("enabled").alias("__e"), F.col("hmac_secret").alias("__k"))
    j = requests.join(d, "device_id", "left")
    made = hmac_sha256(F.col("__k"), canonical_request(*[F.col(c) for c in ("method", "path")], F.col("device_id"), F.col("ts_s").cast("string"), F.col("request_id"), F.col("body_sha256")))
    missing = F.lit(False)
    for c in ("device_id", "ts_s", "request_id", "body_sha256", "signature"):
        missing = missing | F.col(c).isNull()
    code = (
        F.when(missing, "AUTH_REQUIRED").when(F.abs(F.col("ts_s") - now_s) > CLOCK_SKEW_S, "TIMESTAMP_EXPIRED").when(F.col("__e").isNull(), "DEVICE_NOT_FOUND").when(~F.col("__e"), "DEVICE_DISABLED")
        .when(~same_digest(made, F.col("signature")), "SIGNATURE_INVALID").otherwise("OK")
    )
    return j.withColumn("auth_code", code).drop("__e", "__k")


def healthy(checks: dict[str, bool]) -> tuple[bool, str]:
    return all(checks.values()), json.dumps({k: "up" if v else "down" for k, v in sorted(checks.items())})
