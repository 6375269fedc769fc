"""Named collections of clouds: their classes, and which cloud is in which split."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Collection:
    """`num_classes` labels, of which `stuff` can't be counted; splits: name -> cloud ids (trainval is train and val)."""

    name: str
    num_classes: int
    stuff: tuple[int, ...] = ()
    splits: dict[str, tuple[str, ...]] = field(default_factory=dict)
    class_names: tuple[str, ...] = ()
    #: raw label -> label; what isn't listed is void
    labels: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.check_cloud_ids()

    def check_cloud_ids(self) -> None:
        """Raises where a cloud is in two splits."""
        seen: dict[str, str] = {}
        for split, ids in self.splits.items():
            for i in ids:
                if seen.setdefault(i, split) != split:
                    raise ValueError(f"{self.name}: cloud {i} is in the splits {seen[i]} and {split}")

    def label(self, raw: Column) -> Column:
        """The label of a raw one; void for what isn't known."""
        pairs = [F.lit(x) for kv in self.labels.items() for x in kv]
        known = F.try_element_at(F.create_map(*pairs), raw.cast("int")) if pairs else F.lit(None)
        return F.coalesce(known, F.lit(self.void)).cast("int")

    def classes(self, spark: SparkSession) -> DataFrame:
        """(label, name, kind) of each class: kind is stuff, thing or void."""
        names = [*self.class_names, *[f"class {i}" for i in range(len(self.class_names), self.num_classes)]]
        rows = [(i, n, "stuff" if i in self.stuff else "thing") for i, n in enumerate(names)]
        return spark.createDataFrame([*rows, (self.void, "void", "void")], "label int, name string, kind string")

    @property
    def things(self) -> list[int]:
        return [c for c in range(self.num_classes) if c not in self.stuff]

    @property
    def void(self) -> int:
        return self.num_classes

    def cloud_ids(self, split: str) -> list[str]:
        names = ("train", "val") if split == "trainval" else (split,)
        return sorted({i for n in names for i in self.splits.get(n, ())})

    def clouds(self, df: DataFrame, split: str, cloud_id: str = "cloud_id") -> DataFrame:
        """The rows of a split: a filter that reaches the scan."""
        return df.where(F.col(cloud_id).isin(self.cloud_ids(split)))


def fold_split(fold: Column, held: int) -> Column:
    """`test` for the fold that is held out, `train` for the rest."""
    return F.when(fold == held, "test").otherwise("train")


# The public collections' tiles, labels and classes.

DALES = Collection(
    "dales", 8, (0, 1),
    {
        "train": (
            "5080_54435_new", "5190_54400_new", "5105_54460_new", "5130_54355_new", "5165_54395_new", "5185_54390_new",
            "5180_54435_new", "5085_54320_new", "5100_54495_new", "5110_54320_new", "5140_54445_new", "5105_54405_new",
            "5185_54485_new", "5165_54390_new", "5145_54460_new", "5110_54460_new", "5180_54485_new", "5150_54340_new",
            "5145_54405_new", "5145_54470_new", "5160_54330_new", "5135_54495_new", "5145_54480_new", "5115_54480_new",
            "5110_54495_new", "5095_54440_new",
        ),
        "val": ("5145_54340_new", "5095_54455_new", "5110_54475_new"),
        "test": (
            "5080_54470_new", "5100_54440_new", "5140_54390_new", "5080_54400_new", "5155_54335_new", "5150_54325_new",
            "5120_54445_new", "5135_54435_new", "5175_54395_new", "5100_54490_new", "5135_54430_new",
        ),
    },
    ("Ground", "Vegetation", "Cars", "Trucks", "Power lines", "Fences", "Poles", "Buildings"),
    {raw: raw - 1 for raw in range(1, 9)},
)
KITTI360 = Collection(
    "kitti360", 15, tuple(c for c in range(15) if c not in (2, 11)), {},
    (
        "road", "sidewalk", "building", "wall", "fence", "pole", "traffic light", "traffic sign", "vegetation", "terrain",
        "person", "car", "truck", "motorcycle", "bicycle",
    ),
    {7: 0, 8: 1, 11: 2, 12: 3, 13: 4, 17: 5, 19: 6, 20: 7, 21: 8, 22: 9, 24: 10, 26: 11, 27: 12, 32: 13, 33: 14, 34: 2, 35: 4, 37: 5},
)
SCANNET = Collection(
    "scannet", 20, (0, 1), {},
    (
        "wall", "floor", "cabinet", "bed", "chair", "sofa", "table", "door", "window", "bookshelf", "picture", "counter",
        "desk", "curtain", "refrigerator", "shower curtain", "toilet", "sink", "bathtub", "otherfurniture",
    ),
    {raw: i for i, raw in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 24, 28, 33, 34, 36, 39))},
)
S3DIS_CLASSES = (
    "ceiling", "floor", "wall", "beam", "column", "window", "door", "chair", "table", "bookcase", "sofa", "board", "clutter",
)


def s3dis(fold: int = 5, areas: tuple[str, ...] = tuple(f"Area_{i}" for i in range(1, 7)), stuff: tuple[int, ...] = ()) -> Collection:
    """Indoor areas, one of which is held out; the clouds are areas, or the rooms (`Area_1/office_1`) that are given.

    stuff is empty by default; (0, 1, 2) counts ceilings, floors and walls as stuff.
    """
    held = [a for a in areas if a.split("/")[0] == f"Area_{fold}"]
    rest = tuple(a for a in areas if a not in held)
    return Collection("s3dis", 13, stuff, {"train": rest, "test": tuple(held)}, S3DIS_CLASSES, {i: i for i in range(13)})
