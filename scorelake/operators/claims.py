"""Which claims the evidence bears out: containment of claim texts in passages, through the postings of rare tokens.

A claim is verifiable if its tokens (lower-cased runs of letters and digits) stand in a passage one after the other. Equal claims are searched once, and equal
passages once. A claim is looked up by the rarest of its tokens only: the passages that have this token are its candidates, and each candidate is compared as a whole. A claim
with a token that no passage has is settled without any candidate. So the work grows with the passages and the postings of rare tokens, never with claims times passages.

Defined cases: null and empty claims, and claims without a token, are not verifiable but count. Null and empty passages support nothing. A passage that holds a claim in several places supports it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.session import stored_once


def claim_text(text: Column) -> Column:
    """Tokens with one space around each; empty without tokens."""
    joined = F.array_join(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), " ")
    return F.when(joined != "", F.concat(F.lit(" "), joined, F.lit(" "))).otherwise(F.lit(""))


def sentences(text: Column) -> Column:
    """A text's sentences: what full stops, question and exclamation marks, and line ends part; blank ones left out."""
    return F.filter(F.split(text, r"[.!?\n]+"), lambda s: F.trim(s) != "")


def _tokens(normal: str) -> Column:
    return F.array_distinct(F.split(F.trim(F.col(normal)), " "))


def claim_support(claims: DataFrame, passages: DataFrame, claim: str = "claim", passage: str = "text") -> DataFrame:
    """(normal, supporting): for every different claim text with tokens, the number of passages that hold it."""
    wanted = stored_once(claims.select(claim_text(F.col(claim)).alias("normal")).where("normal <> ''").distinct(), "claim-texts")
    held = passages.select(claim_text(F.col(passage)).alias("held")).where("held <> ''").groupBy("held").agg(F.count("*").alias("copies"))
    held = stored_once(held.withColumn("pid", F.xxhash64("held")), "passage-texts")
    asked = wanted.select("normal", F.explode(_tokens("normal")).alias("token"))
    # Postings of the tokens that some claim has; how often each occurs tells a claim's rarest.
    postings = held.select("pid", F.explode(_tokens("held")).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    postings = stored_once(postings, "claim-postings")
    often = postings.groupBy("token").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "token", "left").groupBy("normal").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare"))
    probes = rarest.where("rare.n > 0").select("normal", F.col("rare.token").alias("token"))
    candidates = probes.join(postings, "token").select("normal", "pid")
    hits = candidates.join(held, "pid").where(F.contains("held", F.col("normal"))).groupBy("normal").agg(F.sum("copies").alias("supporting"))
    return wanted.join(hits, "normal", "left").select("normal", F.coalesce("supporting", F.lit(0)).alias("supporting"))


def claim_verifiability(claims: DataFrame, passages: DataFrame, keys: list[str], claim: str = "claim", passage: str = "text", enough: int = 2) -> DataFrame:
    """Per key: ``n_claims``, ``n_verifiable``, ``verifiable_rate``, ``sufficient_rate`` (claims that ``enough`` passages or more hold) and ``least_support``."""
    support = stored_once(claim_support(claims, passages, claim, passage), "claim-support")
    rows = claims.withColumn("_normal", claim_text(F.col(claim))).join(support.withColumnRenamed("normal", "_normal"), "_normal", "left")
    n, held = F.count("*"), F.coalesce("supporting", F.lit(0))
    return rows.groupBy(*keys).agg(
        n.alias("n_claims"), F.count_if(held > 0).alias("n_verifiable"), F.round(F.count_if(held > 0) / n, 4).alias("verifiable_rate"),
        F.round(F.count_if(held >= enough) / n, 4).alias("sufficient_rate"), F.min(held).alias("least_support"))
