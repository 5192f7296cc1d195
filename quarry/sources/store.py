"""Object stores: Spark's own s3a file system, configured for any compatible endpoint."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from quarry.errors import EngineError, ErrorCode

LOCAL = ("", "file")


def configure_s3(spark: SparkSession, endpoint: str, access_key: str, secret_key: str, region: str = "us-east-1") -> None:
    """Path-style access with request signatures; secrets stay in this session's Hadoop settings."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in {"endpoint": endpoint, "access.key": access_key, "secret.key": secret_key, "endpoint.region": region, "path.style.access": "true", "connection.ssl.enabled": str(endpoint.startswith("https")).lower()}.items():
        conf.set(f"fs.s3a.{k}", v)


def resolved(spark: SparkSession, location: str) -> str:
    """A location Spark can open: s3 becomes s3a, and needs configure_s3 first."""
    scheme = urlsplit(location).scheme
    if scheme in ("s3", "s3a"):
        if not spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.endpoint"):
            raise EngineError(ErrorCode.INVALID_REQUEST, "No object store is configured for s3 locations.")
        return "s3a" + location[location.index(":") :]
    return location
