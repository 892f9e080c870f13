"""Weighted polygenic scoring from the merged frame and a weight table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusloom.functions.genotype import genotype_text_dosage
from locusloom.operators.pgs import normalise_to_reference
from locusloom.schemas import USER_SAMPLE
from locusloom.session import stage

_PLACE = ["chromosome", "position"]
NO_CALLS = ("./.", ".|.")


def join_weights(merged: DataFrame, weights: DataFrame, key: str = "place") -> DataFrame:
    """Merged variants with the weights of every trait that uses them.

    By place the weight's alleles have to be the variant's two alleles, either way round; by
    rsid only the effect allele is checked. The join runs on variants, before samples are
    exploded.
    """
    w = weights.select("trait", "rsid", *_PLACE, "effect_allele", "weight", *[c for c in ("other_allele", "p_value") if c in weights.columns])
    effect = F.col("effect_allele")
    fits = (effect == F.col("alt_allele")) | (effect == F.col("ref_allele"))
    if key == "rsid":
        joined = merged.join(w.drop(*_PLACE).filter(F.col("rsid").isNotNull()), "rsid")
    else:
        joined = merged.join(w.drop("rsid"), _PLACE)
    if "other_allele" in w.columns and key != "rsid":
        other = F.col("other_allele")
        fits = fits & ((other == F.col("alt_allele")) | (other == F.col("ref_allele"))) & (other != effect)
    return joined.filter(fits)


def raw_scores(merged: DataFrame, weights: DataFrame, key: str = "place") -> DataFrame:
    """Per trait and sample: ``raw_score`` = sum of effect-allele dosage times weight, and ``snp_count``.

    No-calls and variants that were not observed in the person count for nothing; a sample without any called
    variant of a trait has no score for it.
    """
    rows = join_weights(merged, weights, key).select(
        "trait", "weight", (F.col("effect_allele") == F.col("alt_allele")).alias("_alt"),
        F.when(F.col("user_observed"), F.col("user_dosage")).alias("user_dosage"),
        F.size("sample_genotypes").alias("_last"),
        F.concat("sample_genotypes", F.array("user_genotype")).alias("_cells"),
    )
    rows = rows.select("trait", "weight", "_alt", "user_dosage", "_last", F.posexplode_outer("_cells").alias("_i", "_g"))
    dosage = F.when(F.col("_i") == F.col("_last"), F.col("user_dosage")).when(
        ~F.col("_g").isin(*NO_CALLS), genotype_text_dosage("_g"))
    effect_dosage = F.when(F.col("_alt"), dosage).otherwise(F.lit(2.0) - dosage)
    # Summed by the sample's number; its name is built once per group.
    sums = rows.groupBy("trait", "_i").agg(
        F.sum(effect_dosage * F.col("weight")).alias("raw_score"), F.count(effect_dosage).alias("snp_count"))
    return sums.filter("snp_count > 0").select(
        "trait", F.concat(F.lit("samp"), (F.col("_i") + 1).cast("string")).alias("sample_id"), "raw_score", "snp_count")


def with_coverage(scores: DataFrame, weights: DataFrame, min_coverage: float | None = None) -> DataFrame:
    """Add ``coverage`` = used / all weights of the trait; drop traits below the minimum."""
    totals = weights.groupBy("trait").agg(F.count("*").alias("_weights"))
    out = scores.join(totals, "trait").withColumn("coverage", F.col("snp_count") / F.col("_weights")).drop("_weights")
    return out if min_coverage is None else out.filter(F.col("coverage") >= float(min_coverage))


def pgs_results(
    merged: DataFrame, weights: DataFrame, min_coverage: float | None = 0.8, key: str = "place",
) -> DataFrame:
    """trait, sample_id, raw_score, normalized_score, percentile, snp_count, coverage.

    Raw scores are kept to six decimals, as they are stored; sums that differ only in their last
    bits then count as equal. Normalised by the panel samples' mean and sd; the percentile is the
    share of the trait's panel samples with a smaller score (equal scores don't count as smaller).
    """
    raw = raw_scores(merged, weights, key).withColumn("raw_score", F.round("raw_score", 6) + F.lit(0.0))
    # Traits times samples, a short table that is used several times below.
    scores = stage(with_coverage(raw, weights, min_coverage), "raw-scores")
    named = scores.withColumnsRenamed({"trait": "label", "raw_score": "value"})
    scored = normalise_to_reference(named, F.col("sample_id") != USER_SAMPLE)
    # A trait has one row per sample, so these windows are short.
    of_panel = F.count_if(F.col("sample_id") != USER_SAMPLE)
    up_to, equal = Window.partitionBy("label").orderBy("value"), Window.partitionBy("label", "value")
    below = of_panel.over(up_to) - of_panel.over(equal)
    ranked = scored.withColumn("percentile", F.try_divide(below * 100.0, of_panel.over(Window.partitionBy("label"))))
    return ranked.select(
        F.col("label").alias("trait"), "sample_id", F.col("value").alias("raw_score"),
        F.col("z").alias("normalized_score"), "percentile", "snp_count", "coverage",
    )


def manhattan_series(merged: DataFrame, weights: DataFrame) -> DataFrame:
    """Chart points: place, trait, p-value, weight and the person's dosage."""
    return join_weights(merged, weights).select(
        "trait", *_PLACE, "rsid", "p_value", F.col("weight").alias("beta"), "user_dosage")


def significant_loci(points: DataFrame, threshold: float = 5e-8) -> DataFrame:
    """Per trait: points and those below the threshold."""
    return points.groupBy("trait").agg(
        F.count("*").alias("points"), F.count_if(F.col("p_value") < threshold).alias("significant_loci"))


def sample_gram(merged: DataFrame) -> DataFrame:
    """i, j, v: the samples' centred Gram matrix, summed over variants.

    The dosage matrix has 51 rows however many variants there are, so each task sums its variants and only
    51 x 51 cells a task are shuffled. A missing dosage counts as its variant's mean. All rows must hold one number of samples.
    """
    dosages = F.concat(F.transform("sample_genotypes", genotype_text_dosage), F.array("user_dosage"))
    vectors = merged.select(dosages.alias("_d")).filter(F.col("_d").isNotNull())

    def gram(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)  # null is NaN
            known = ~np.isnan(flat)
            mean = np.where(known, flat, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
            centred = np.where(known, flat - mean[:, None], 0.0)
            part = centred.T @ centred
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())],
                names=["i", "j", "v"])

    return vectors.mapInArrow(gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def ancestry_components(merged: DataFrame, k: int = 2) -> DataFrame:
    """Principal components of the sample-by-variant dosage matrix, one row per sample; empty for no variants.

    The decomposition is of ``sample_gram``'s fixed-size matrix, in one task of 51 x 51 cells.
    """
    def decompose(cells):
        import numpy as np
        import pandas as pd

        n = int(cells["i"].max()) + 1
        matrix = np.zeros((n, n))
        matrix[cells["i"], cells["j"]] = cells["v"]
        values, axes = np.linalg.eigh(matrix)
        order = np.argsort(values)[::-1][:k]
        scores = axes[:, order] * np.sqrt(np.maximum(values[order], 0.0))
        # The sign of a component is free: make its largest entry positive.
        scores = scores * np.sign(scores[np.abs(scores).argmax(axis=0), np.arange(len(order))])
        out = pd.DataFrame({f"pc{c + 1}": scores[:, c] if c < len(order) else 0.0 for c in range(k)})
        out.insert(0, "sample_id", [f"samp{s + 1}" for s in range(n)])
        return out

    schema = "sample_id string, " + ", ".join(f"pc{c + 1} double" for c in range(k))
    return sample_gram(merged).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(decompose, schema)


def ancestry_distances(components: DataFrame) -> DataFrame:
    """sample_a, sample_b, distance of each two samples by their components, in both orders.

    The distances don't depend on the components' signs. With all components they equal the distances of the dosages.
    """
    axes = [c for c in components.columns if c != "sample_id"]
    # One row a sample: 51 of them, from one task, joined with themselves.
    a = components.select(F.col("sample_id").alias("sample_a"), F.array(*axes).alias("_a"))
    b = components.select(F.col("sample_id").alias("sample_b"), F.array(*axes).alias("_b"))
    square = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return a.join(b, F.col("sample_a") != F.col("sample_b")).select("sample_a", "sample_b", F.sqrt(square).alias("distance"))
