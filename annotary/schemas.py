"""Explicit schemas for every source and every output; nothing is inferred."""

from pyspark.sql import types as T

RING = T.ArrayType(T.DoubleType())
RINGS = T.ArrayType(RING)

INSTANCE = T.StructType(
    [
        T.StructField("source_class", T.StringType()),
        T.StructField("polygon", RINGS),
        T.StructField("bbox", RING),
        T.StructField("area", T.DoubleType()),
    ]
)

RECORDS = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("split_hint", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("instances", T.ArrayType(INSTANCE)),
    ]
)
RECORD_COLUMNS = [field.name for field in RECORDS]

CANONICAL_CLASSES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("group", T.StringType()),
        T.StructField("size", T.StringType()),
    ]
)
CLASS_MAPPINGS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_class", T.StringType()),
        T.StructField("canonical", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("note", T.StringType()),
    ]
)

VIA_FILE = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField(
                "regions",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("all_x", RING),
                            T.StructField("all_y", RING),
                            T.StructField("class", T.StringType()),
                        ]
                    )
                ),
            ),
        ]
    ),
)

# `segmentation` is read as text: a polygon list and a run-length object share
# the field, and only the text tells them apart.
COCO_DOCUMENT = T.StructType(
    [
        T.StructField(
            "images",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("width", T.IntegerType()),
                        T.StructField("height", T.IntegerType()),
                        T.StructField("file_name", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "annotations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("image_id", T.LongType()),
                        T.StructField("category_id", T.IntegerType()),
                        T.StructField("segmentation", T.StringType()),
                        T.StructField("iscrowd", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "categories",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.IntegerType()),
                        T.StructField("name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

POINT_LIST = T.ArrayType(RING)
SUPERVISELY_FILE = T.StructType(
    [
        # Present only in the JSON-lines layout, where the file name no longer
        # carries the image name.
        T.StructField("name", T.StringType()),
        T.StructField(
            "objects",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("classTitle", T.StringType()),
                        T.StructField("geometryType", T.StringType()),
                        T.StructField(
                            "points",
                            T.StructType(
                                [
                                    T.StructField("exterior", POINT_LIST),
                                    T.StructField("interior", T.ArrayType(POINT_LIST)),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField(
            "size",
            T.StructType(
                [
                    T.StructField("height", T.IntegerType()),
                    T.StructField("width", T.IntegerType()),
                ]
            ),
        ),
    ]
)
SUPERVISELY_META = T.StructType(
    [
        T.StructField(
            "classes", T.ArrayType(T.StructType([T.StructField("title", T.StringType())]))
        )
    ]
)

RUN_CONFIG = T.StructType(
    [
        T.StructField("seed", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("copy_paste", T.BooleanType()),
        T.StructField("density_bucket", T.ArrayType(T.IntegerType())),
        T.StructField("subset_n_images", T.IntegerType()),
        T.StructField("corpus", T.ArrayType(T.StringType())),
        T.StructField("iterations", T.IntegerType()),
    ]
)
RUN_SUMMARY = T.StructType(
    [
        T.StructField("iterations", T.IntegerType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("num_train_images", T.IntegerType()),
        T.StructField("best_val_iou", T.DoubleType()),
        T.StructField("best_iteration", T.IntegerType()),
        T.StructField("final_train_loss", T.DoubleType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
    ]
)
RUN_EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("iteration", T.LongType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("mean_iou_damage", T.DoubleType()),
        T.StructField("iou_per_class", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("dice_per_class", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("ece", T.DoubleType()),
        T.StructField("brier_score", T.DoubleType()),
    ]
)

# Masks are run-length tables: pixels x0 .. x1-1 of row y.
RUNS = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("class", T.IntegerType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("x1", T.IntegerType()),
    ]
)
