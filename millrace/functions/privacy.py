"""Privacy strategies for columns: redact, hash, exclude, tokenize."""

from __future__ import annotations

from millrace.runtime import cut
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Keys that a hot token is dealt over when its value is told.
SALTS = 16

#: What is redacted, in this order.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CARD": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "PHONE": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
}


#: The address pattern with the same matches in linear time: a run of name characters is tried once, at its start or where the last match ended.
_LINEAR = {"EMAIL": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}


def redact(c: Column) -> Column:
    for name, pattern in PATTERNS.items():
        c = F.regexp_replace(c, _LINEAR.get(name, pattern), f"<{name}>")
    return c


def pseudonym(c: Column, salt: str) -> Column:
    """A salted hash; null stays null."""
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def token(c: Column, salt: str = "", prefix: str = "tok_") -> Column:
    """A value's token: 128 bits of a salted hash, the same in every run with the salt; null stays null."""
    return F.concat(F.lit(prefix), F.substring(pseudonym(c, salt), 1, 32))


def protect(df: DataFrame, strategies: dict[str, str], salt: str = "", vault: TokenVault | None = None) -> DataFrame:
    """Apply redact, hash, exclude or tokenize to columns by name. vault: where the values of tokens are kept, so that they can be told again."""
    for column, how in strategies.items():
        if how == "redact":
            df = df.withColumn(column, redact(F.col(column)))
        elif how == "hash":
            df = df.withColumn(column, pseudonym(F.col(column), salt))
        elif how == "exclude":
            df = df.drop(column)
        elif how == "tokenize":
            if vault is not None:
                vault.add(df, column)
            df = df.withColumn(column, token(F.col(column), vault.salt if vault else salt))
        else:
            raise ValueError(f"unknown privacy strategy: {how}")
    return df


class TokenCollision(Exception):
    """Two values have one token."""


class TokenVault:
    """Values by token in an append-only table, one salt for all.

    A token follows from its value, so jobs agree without reading the table, and
    two jobs that add a value at once add the same row; it is read as one.
    """

    def __init__(self, spark: SparkSession, path: str, salt: str, prefix: str = "tok_"):
        self.spark, self.path, self.salt, self.prefix = spark, path.rstrip("/"), salt, prefix

    def read(self) -> DataFrame:
        """(token, value)."""
        try:
            return self.spark.read.schema("token string, value string").parquet(self.path).distinct()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "token string, value string")

    def add(self, df: DataFrame, column: str) -> DataFrame:
        """Appends the column's values that the vault lacks, and gives them; an error if a token would stand for two values."""
        values = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value is not null").distinct()
        rows = values.select(token(F.col("value"), self.salt, self.prefix).alias("token"), "value")
        fresh = cut(rows.join(self.read(), ["token", "value"], "left_anti"))
        both = fresh.unionByName(self.read().join(fresh.select("token"), "token", "left_semi"))
        if not both.groupBy("token").agg(F.min("value").alias("a"), F.max("value").alias("b")).filter("a <> b").isEmpty():
            raise TokenCollision("values share a token: use another salt")
        fresh.write.mode("append").parquet(self.path)
        return fresh

    def reveal(self, df: DataFrame, column: str) -> DataFrame:
        """The column's tokens replaced by their values; what is no token of the vault is null.

        A token that very many rows share is split: rows meet the vault by token
        and one of SALTS salts.
        """
        salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        known = self.read().select(F.col("token").alias("_token"), F.col("value").alias("_value"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
        cell = F.col(f"`{column}`")
        met = salted.join(known, (cell == F.col("_token")) & (salted["_salt"] == known["_salt"]), "left")
        return met.select(*[(F.col("_value").alias(c) if c == column else salted[f"`{c}`"]) for c in df.columns])
