"""Fisher's exact test on two-by-two tables, one test per row of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import ln_factorial

TERMS_PER_CHUNK = 4096
TIE_TOLERANCE = 1e-7
# exp(-745) is zero as a double: terms beyond this distance add nothing.
LN_SMALLEST = 745.0


def fisher_exact(
    df: DataFrame, a: str, b: str, c: str, d: str, keys: list[str], out: str = "p_value"
) -> DataFrame:
    """Add the two-sided p-value of the table [[a, b], [c, d]].

    ``keys`` must identify a row. The p-value sums the hypergeometric terms that
    are no more likely than the observed one. Hoeffding's bound gives the range
    outside of which every term is zero in double precision, so the number of
    terms grows with the square root of the counts. Terms are generated in
    chunks that spread over tasks.
    """
    a_, b_, c_, d_ = (F.col(x).cast("bigint") for x in (a, b, c, d))
    row1, row2, col1 = a_ + b_, c_ + d_, a_ + c_
    total = row1 + row2
    margins = df.select(
        *keys,
        a_.alias("_a"),
        row1.alias("_r1"),
        row2.alias("_r2"),
        col1.alias("_c1"),
        total.alias("_n"),
    )
    smallest = F.least(
        F.col("_r1"), F.col("_r2"), F.col("_c1"), F.col("_n") - F.col("_c1")
    )
    expected = F.col("_r1") * (F.col("_c1") / F.greatest(F.col("_n"), F.lit(1)))
    reach = F.sqrt(F.lit(LN_SMALLEST / 2) * smallest) + 1.0
    fixed = (
        ln_factorial(F.col("_r1"))
        + ln_factorial(F.col("_r2"))
        + ln_factorial(F.col("_c1"))
        + ln_factorial(F.col("_n") - F.col("_c1"))
        - ln_factorial(F.col("_n"))
    )

    def ln_term(x):
        return F.col("_fixed") - (
            ln_factorial(x)
            + ln_factorial(F.col("_r1") - x)
            + ln_factorial(F.col("_c1") - x)
            + ln_factorial(F.col("_r2") - F.col("_c1") + x)
        )

    bounded = (
        margins.withColumn("_fixed", fixed)
        .withColumn(
            "_lo",
            F.greatest(
                F.lit(0), F.col("_c1") - F.col("_r2"), F.floor(expected - reach)
            ).cast("bigint"),
        )
        .withColumn(
            "_hi", F.least(F.col("_r1"), F.col("_c1"), F.ceil(expected + reach)).cast("bigint")
        )
        .withColumn("_limit", ln_term(F.col("_a")) + F.log1p(F.lit(TIE_TOLERANCE)))
    )
    chunks = bounded.withColumn(
        "_from",
        F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(TERMS_PER_CHUNK).cast("bigint"))),
    )
    terms = chunks.withColumn(
        "_x",
        F.explode(
            F.sequence(
                F.col("_from"),
                F.least(F.col("_from") + (TERMS_PER_CHUNK - 1), F.col("_hi")),
            )
        ),
    ).withColumn("_ln", ln_term(F.col("_x")))
    summed = terms.groupBy(*keys).agg(
        F.sum(F.when(F.col("_ln") <= F.col("_limit"), F.exp("_ln")).otherwise(0.0)).alias("_p")
    )
    p = F.least(F.col("_p"), F.lit(1.0))
    return df.join(summed, keys, "left").withColumn(out, p).drop("_p")
