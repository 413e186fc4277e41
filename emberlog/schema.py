"""Record layouts and fixed lookup values of the log model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Syslog severity and facility codes as they arrive in the raw
# event, and the names stored in the log document.
SEVERITIES = {
    "0": "emergency",
    "1": "alert",
    "2": "critical",
    "3": "error",
    "4": "warning",
    "5": "notice",
    "6": "info",
    "7": "debug",
}
FACILITIES = {
    "0": "kern",
    "1": "user",
    "2": "mail",
    "3": "daemon",
    "4": "auth",
    "5": "syslog",
    "6": "lpr",
    "7": "news",
    "8": "uucp",
    "9": "cron",
    "10": "authpriv",
    "11": "ftp",
    "12": "ntp",
    "13": "security",
    "14": "console",
    "15": "solariscron",
    "16": "local0",
    "17": "local1",
    "18": "local2",
    "19": "local3",
    "20": "local4",
    "21": "local5",
    "22": "local6",
    "23": "local7",
}

# Keys of a raw event. Every required key must be a JSON string.
REQUIRED_KEYS = [
    "msg",
    "timereported",
    "timegenerated",
    "hostname",
    "syslogtag",
    "inputname",
    "fromhost",
    "fromhost-ip",
    "syslogseverity",
    "syslogfacility",
    "programname",
    "protocol-version",
    "app-name",
]
OPTIONAL_KEYS = ["procid", "msgid", "uuid"]
VARIABLES_KEY = "$!"
STRUCTURED_DATA_KEY = "structured-data"

RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField(k, T.StringType())
        for k in [*REQUIRED_KEYS, *OPTIONAL_KEYS, VARIABLES_KEY, STRUCTURED_DATA_KEY]
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("tstamp", T.TimestampType()),
        T.StructField("doc", T.StringType()),
        T.StructField("doc_v", T.VariantType()),
        T.StructField("search", T.ArrayType(T.StringType())),
    ]
)

# Document fields of imported events that are kept as real columns too: always
# plain strings, and often filtered on.
DEFAULT_PROMOTED = ("hostname", "programname", "syslogseverity")

# Column types that may stand for a document field, by kind of JSON value.
_KINDS = {
    "string": "text",
    "int": "integer",
    "bigint": "integer",
    "smallint": "integer",
    "tinyint": "integer",
    "double": "fraction",
}


@dataclass(frozen=True)
class Promoted:
    """A document field that is also a column; NULL means the field is absent."""

    column: str
    type: str

    def __post_init__(self) -> None:
        if self.type not in _KINDS:
            raise ValueError(f"{self.column}: a {self.type} column cannot stand for a field")

    @property
    def kind(self) -> str:
        return _KINDS[self.type]


@dataclass(frozen=True)
class LogColumns:
    """Where the parts of a log row live in a DataFrame.

    ``promoted`` maps field names to columns that hold the same values. Getters
    and predicates on these fields then work on the columns, so that scans read
    only them and filters reach the Parquet reader.

    ``shredded`` tells that ``doc_v`` is stored with a column per frequent key. Getters
    then take text and numbers from it as well and never from ``doc``, so a scan reads
    the one key and not the documents.
    """

    id: str = "id"
    tstamp: str = "tstamp"
    doc: str = "doc"
    doc_v: str = "doc_v"
    search: str = "search"
    promoted: Mapping[str, Promoted] = field(default_factory=dict)
    shredded: bool = False

    def promote(self, **columns: str) -> LogColumns:
        """Add string columns, given as ``field="column"``."""
        return self.promote_from({name: (column, "string") for name, column in columns.items()})

    def promote_from(self, columns: Mapping[str, tuple[str, str]]) -> LogColumns:
        """Add columns given as ``{field: (column, type)}``."""
        added = {name: Promoted(column, kind) for name, (column, kind) in columns.items()}
        return replace(self, promoted={**self.promoted, **added})


LOG_COLUMNS = LogColumns()

# Columns of a stored log table, without and with the default promoted fields.
SHREDDED_COLUMNS = replace(LOG_COLUMNS, shredded=True)
STORED_COLUMNS = SHREDDED_COLUMNS.promote(
    **{name: name for name in DEFAULT_PROMOTED}
)
