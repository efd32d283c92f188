"""Study parameters and fixed code lists."""

from __future__ import annotations

from dataclasses import dataclass

ENTITY, DATE, FEATURE, VALUE = "entity_id", "date", "feature", "value"


@dataclass(frozen=True)
class StudyParams:
    """Every number an operator may need; defaults are the published study's."""

    observation_days: int = 730
    prediction_days: int = 50
    train_fraction: float = 0.8
    seed: int = 1
    diag_min: int = 30
    lab_min: int = 50
    med_min: int = 50
    microbiology_min: int = 10
    admission_min: int = 0
    procedure_min: int = 50
    tfidf_terms: int = 200
    top_features: int = 10
    select_features: int = 500


# Three-digit diagnosis codes of the respiratory groups.
RESPIRATORY_GROUPS = {
    "acute": range(460, 467),
    "other_upper_tract": range(470, 479),
    "pneumonia_and_influenza": range(480, 489),
    "chronic_obstructive": range(490, 497),
    "external_agents": range(500, 509),
    "other_respiratory": range(510, 520),
}

# The English list that Spark's StopWordsRemover ships.
ENGLISH_STOP_WORDS = (
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's
    it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't
    don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could
    here's how's let's ought that's there's what's when's where's who's why's would
    """
).split()
