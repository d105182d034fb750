"""The five cohort questions as named lazy results, chosen by number."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from sightline import fixed_values as fv
from sightline.operators import charts, cohort
from sightline.operators.cohort import DEFAULT, CohortColumns


def cohort_questions(
    enc: DataFrame,
    sdoh: DataFrame,
    diag: DataFrame,
    dept: DataFrame,
    geo: DataFrame,
    which: Sequence[str] = ("1", "2", "3", "4", "5"),
    years: tuple[int, int] = fv.YEAR_WINDOW,
    cols: CohortColumns = DEFAULT,
) -> dict[str, DataFrame]:
    """Result tables of the chosen questions. Nothing runs until a table is used."""
    enc = cohort.cast_flags(enc, cols)

    def first() -> dict[str, DataFrame]:
        tested = cohort.screened_rates_tested(enc, sdoh, cols)
        return {"ed_rate_by_domain": tested, "ed_odds_by_domain": cohort.odds_ratios(tested)}

    def second() -> dict[str, DataFrame]:
        return {
            "utilizer_summary": cohort.utilizer_summary(enc, sdoh, cols),
            "top_diagnoses": cohort.top_diagnoses(enc, diag, cols),
            "encounter_histogram": charts.histogram(
                cohort.capped_counts(enc, cols), "encounter_count", fv.ENCOUNTER_BINS
            ),
        }

    def third() -> dict[str, DataFrame]:
        areas = cohort.area_geography(cohort.area_summary(enc, sdoh, dept, cols), geo, cols)
        return {
            "areas": areas,
            "volume_and_rate": cohort.busy_areas(areas),
            "underscreened": cohort.underscreened_areas(areas),
            "map_layer": cohort.map_layer(areas, cols),
        }

    def fourth() -> dict[str, DataFrame]:
        share = cohort.row_percent(cohort.top_groups(cohort.cooccurrence(enc, sdoh, diag, cols)))
        return {"domain_share": share, "top_domain": cohort.top_domain(share)}

    def fifth() -> dict[str, DataFrame]:
        trend = cohort.top_domains(cohort.yearly_domains(enc, sdoh, years, cols))
        return {
            "rate_by_year": cohort.yearly_rate(enc, sdoh, years, cols),
            "growth_by_domain": cohort.yearly_growth(trend),
        }

    build: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "1": first, "2": second, "3": third, "4": fourth, "5": fifth,
    }
    out: dict[str, DataFrame] = {}
    for number in which:
        if str(number) in build:
            out.update({f"q{number}_{k}": v for k, v in build[str(number)]().items()})
    return out
