"""Model tables from survey and exposure-event tables.

The steps keep their order on purpose: thresholds and quality flags come before one event
per survey is chosen, complete cases and site exclusions after it. Moving the complete-case
filter first would promote a different event of the same survey.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions import residual
from coppice.operators.cohorts import (
    at_least,
    complete_cases,
    exclude,
    first_per_group,
    in_set,
    unexposed,
)
from coppice.operators.features import group_mean, ratio_to_group_mean
from coppice.operators.joins import join_on_pairs, left_join_expecting
from coppice.session import stage


@dataclass(frozen=True)
class SurveyColumns:
    """Names of the columns with a role in table building."""

    site: str = "SITE_ID"
    survey: str = "site_survey_id"
    width: str = "bankfull_mean"
    relative_width: str = "relative_bankfull"
    quality: str = "QC_visit_x"
    keep_quality: str = "N"
    region: str = "AQUA_PROV"
    share: str = "ppc_burned_perc"
    size: str = "ppc_burned_sqkm"
    event_year: str = "fire_year"


def site_means(surveys: DataFrame, cols: SurveyColumns = SurveyColumns()) -> DataFrame:
    """Mean width of every site over all its surveys, staged for use in several joins."""
    return stage(group_mean(surveys, cols.site, cols.width, "site_mean"), "site-means")


def _with_ratio(df: DataFrame, means: DataFrame, cols: SurveyColumns) -> DataFrame:
    kept = df.where(F.col(cols.quality) == F.lit(cols.keep_quality))
    ratio = ratio_to_group_mean(
        kept, means, cols.site, cols.width, "site_mean", cols.relative_width, derived=False
    )
    return ratio.drop("site_mean")


def exposed_surveys(
    events: DataFrame,
    means: DataFrame,
    min_share: float = 1.0,
    strict: bool = False,
    cols: SurveyColumns = SurveyColumns(),
) -> DataFrame:
    """Survey x event rows above the exposure threshold with the wanted quality flag."""
    return _with_ratio(at_least(events, cols.share, min_share, strict), means, cols)


def unexposed_surveys(
    surveys: DataFrame,
    exposed: DataFrame,
    means: DataFrame,
    cols: SurveyColumns = SurveyColumns(),
) -> DataFrame:
    """Surveys that never occur in ``exposed``.

    As ``exposed`` is already filtered, a survey with only sub-threshold or flagged events
    stays in the unexposed cohort.
    """
    return unexposed(_with_ratio(surveys, means, cols), exposed, cols.survey)


def one_event_per_survey(
    exposed: DataFrame,
    tie_break: Sequence[str],
    order_by: str | None = None,
    descending: bool = False,
    cols: SurveyColumns = SurveyColumns(),
) -> DataFrame:
    """The first event of each survey by size (default, smallest first) or another column."""
    return first_per_group(
        exposed, cols.survey, order_by or cols.size, list(tie_break), descending
    )


def model_rows(
    df: DataFrame,
    columns: Sequence[str],
    regions: Sequence[str] | None = None,
    unwanted: Mapping[str, object] | None = None,
    cols: SurveyColumns = SurveyColumns(),
) -> DataFrame:
    """Selected columns, complete cases, wanted regions and exclusions."""
    chosen = list(dict.fromkeys([*columns, *([cols.region] if regions else [])]))
    rows = complete_cases(df, chosen)
    if regions:
        rows = in_set(rows, cols.region, regions)
    if unwanted:
        rows = exclude(rows, unwanted)
    return rows.select(*columns)


def difference_rows(
    predictions: DataFrame,
    linkage: DataFrame,
    exposures: DataFrame,
    columns: Sequence[str],
    site_year: Mapping[str, str],
    survey: str = "site_survey_id",
    drop: Sequence[str] = (),
    sign: str = "predicted-observed",
) -> DataFrame:
    """Prediction errors of a transferred model joined to the exposure covariates.

    ``site_year`` maps the prediction's key columns to those of the linkage table, which
    gives the survey id; several predictions (one per model) meet several exposure rows.
    """
    errors = predictions.withColumn("difference", residual("predicted", "observed", sign))
    linked = join_on_pairs(errors, linkage.drop(*drop), dict(site_year))
    joined = left_join_expecting(linked, exposures, [survey], "m:n")
    return complete_cases(joined, list(columns))
