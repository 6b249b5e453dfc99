"""Hand-made splits: stages of classes, and what survived of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The stages of each split with their classes, in order, and counts reported for them.
SPLITS: dict[str, dict[str, list[str]]] = {
    "Sem-A": {
        "Stage 1 – Bedroom/Lounge": ["bed", "pillow", "lamp", "curtain", "mirror", "picture", "sofa", "light"],
        "Stage 2 – Office/Study": ["desk", "monitor", "keyboard", "chair", "table", "shelf", "book", "paper"],
        "Stage 3 – Kitchen/Utility": ["counter", "cabinet", "bottle", "cup", "box", "bag", "window", "door"],
    },
    "Sem-B": {
        "Stage 1 – Bedroom core": ["bed", "pillow", "lamp", "curtain"],
        "Stage 2 – Bedroom accessories": ["mirror", "picture", "sofa", "light"],
        "Stage 3 – Office core": ["monitor", "keyboard", "desk", "chair"],
        "Stage 4 – Study/library": ["table", "shelf", "book", "paper"],
        "Stage 5 – Kitchen": ["counter", "cabinet", "bottle", "cup"],
        "Stage 6 – Storage/circulation": ["box", "bag", "window", "door"],
    },
    "Surv-A": {
        "Stage 1 – High-freq (structural/furniture)": ["chair", "table", "window", "door", "cabinet", "shelf", "desk", "box"],
        "Stage 2 – Mid-freq (decor/study objects)": ["picture", "book", "paper", "lamp", "sofa", "pillow", "bed", "monitor"],
        "Stage 3 – Low-freq (kitchen/accessories)": ["curtain", "bottle", "bag", "mirror", "counter", "keyboard", "light", "cup"],
    },
    "Surv-B": {
        "Stage 1 – Top-freq 1-4": ["chair", "table", "window", "door"],
        "Stage 2 – Top-freq 5-8": ["cabinet", "shelf", "desk", "box"],
        "Stage 3 – Mid-freq 9-12": ["picture", "book", "paper", "lamp"],
        "Stage 4 – Mid-freq 13-16": ["sofa", "pillow", "bed", "monitor"],
        "Stage 5 – Low-freq 17-20": ["curtain", "bottle", "bag", "mirror"],
        "Stage 6 – Low-freq 21-24": ["counter", "keyboard", "light", "cup"],
    },
}
SEMANTIC_3_SURVIVAL = [(1, 4581, 442, 90.4), (2, 8144, 2727, 66.5), (3, 6808, 6808, 0.0)]
#: Scenes that survive in the last stage of each split, as reported.
LAST_STAGE_SURVIVAL = {"Sem-A": 6808, "Sem-B": 5807, "Surv-A": 4169, "Surv-B": 2264}


def split_rows(splits: dict[str, dict[str, list[str]]] = SPLITS) -> list[tuple[str, int, str, str, int]]:
    """(split, stage_idx, stage_label, class, position) of every class."""
    return [
        (split, i, label, name, k)
        for split, stages in splits.items()
        for i, (label, names) in enumerate(stages.items(), 1)
        for k, name in enumerate(names, 1)
    ]


def split_table(spark: SparkSession) -> DataFrame:
    """The splits as a long dimension table."""
    return spark.createDataFrame(split_rows(), "split string, stage_idx long, stage_label string, class string, position long")
