"""Fixed values of the catalog format: names and prefixes that stored data carries."""

ID, TYPE = "id", "type"
FILE, FOLDER = "FILE", "FOLDER"
CURRENT_ID = "internal:current_id"
PARENT_ID = "internal:parent_id"
OFFSET, SIZE = "internal:offset", "internal:size"
RELATIVE_PATH = "internal:relative_path"
GDAL_VSI = "internal:gdal_vsi"
SOURCE_FILE, SOURCE_PATH = "internal:source_file", "internal:source_path"
#: Ours: keeps the order of a query's ORDER BY; never stored.
ORDER = "internal:order"

PADDING_PREFIX = "__TACOPAD__"
COLLECTION = "COLLECTION.json"
CONSOLIDATED_FOLDER = ".tacocat"
ARCHIVE_SUFFIXES = (".tacozip", ".zip")
LEGACY_SUFFIXES = (".taco", ".tortilla")
TREE_KEY, FIELDS_KEY = "taco:pit_schema", "taco:field_schema"
MAX_LEVELS = 6

STATS_COLUMNS = ("geotiff:stats",)
SHAPE_COLUMN = "stac:tensor_shape"
GEOMETRY_COLUMNS = ("istac:geometry", "stac:centroid", "istac:centroid")
TIME_COLUMNS = ("istac:time_start", "stac:time_start")

ARCHIVE, PLAIN, CONSOLIDATED = "zip", "folder", "tacocat"

NAVIGATION = {
    ARCHIVE: {ID, TYPE, CURRENT_ID, OFFSET, SIZE},
    PLAIN: {ID, TYPE, CURRENT_ID},
    CONSOLIDATED: {ID, TYPE, CURRENT_ID, OFFSET, SIZE, SOURCE_FILE},
}
NAVIGATION_TEXT = {
    ID: "the sample's name among its siblings",
    TYPE: "FILE or FOLDER",
    CURRENT_ID: "row number in the level; children refer to it",
    OFFSET: "first byte in the archive",
    SIZE: "bytes in the archive",
    SOURCE_FILE: "which archive of a consolidated catalog",
}
CRITICAL_ROOT = {ARCHIVE: {ID, TYPE, OFFSET, SIZE}, PLAIN: {ID, TYPE}, CONSOLIDATED: {ID, TYPE, OFFSET, SIZE}}
CRITICAL_DEEPER = {
    ARCHIVE: {ID, TYPE, OFFSET, SIZE, PARENT_ID},
    PLAIN: {ID, TYPE, PARENT_ID, RELATIVE_PATH},
    CONSOLIDATED: {ID, TYPE, OFFSET, SIZE, PARENT_ID},
}
PROTECTED = {ID, TYPE, PARENT_ID, OFFSET, SIZE, GDAL_VSI, SOURCE_FILE, SOURCE_PATH, RELATIVE_PATH}

# Storage schemes and the virtual file prefixes that stand for them; http keeps its whole URL behind the prefix.
VSI_OF_SCHEME = {
    "s3://": "/vsis3/",
    "gs://": "/vsigs/",
    "az://": "/vsiaz/",
    "azure://": "/vsiaz/",
    "oss://": "/vsioss/",
    "swift://": "/vsiswift/",
}
VSI_HTTP, VSI_SUBFILE, VSI_ZIP = "/vsicurl/", "/vsisubfile/", "/vsizip/"

# Places in a continuous statistics cell.
CELL = ("min", "max", "mean", "std", "valid_pct", "p25", "p50", "p75", "p95")

MERGE_GAP = 4 * 1024 * 1024
MERGE_WASTE = 0.5
HEAD_ROWS = TAIL_ROWS = 5
REPR_ROWS = 100
