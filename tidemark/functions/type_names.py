"""Names of types that mean the same."""

#: Spellings of types, by the common name that they are compared under.
SPELLINGS = {
    "integer": "int int4 integer int32 mediumint serial",
    "bigint": "bigint int8 int64 bigserial uint32",
    "smallint": "smallint int2 int16 uint8 smallserial",
    "tinyint": "tinyint",
    "numeric": "numeric decimal dec number decimal32 decimal64 decimal128",
    "float": "real float4 float32",
    "double": "double float8 float64 float",
    "boolean": "bool boolean",
    "varchar": "varchar nvarchar string fixedstring ipv4 ipv6",
    "char": "char character bpchar",
    "text": "text clob mediumtext longtext tinytext",
    "json": "json map",
    "jsonb": "jsonb",
    "binary": "bytea blob binary varbinary longblob",
    "date": "date date32",
    "timestamp": "timestamp datetime datetime64",
    "timestamptz": "timestamptz",
    "time": "time",
    "timetz": "timetz",
    "uuid": "uuid",
    "interval": "interval",
}
#: Spellings of several words.
LONG_SPELLINGS = {"double precision": "double", "character varying": "varchar", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "timetz"}
TYPE_NAMES = {name: common for common, names in SPELLINGS.items() for name in names.split()} | LONG_SPELLINGS

#: Types that SQLite has under another name, and beginnings of those that it takes as they are.
SQLITE_NAMES = {
    "UUID": "TEXT", "JSON": "TEXT", "JSONB": "TEXT", "BYTEA": "BLOB", "TIMESTAMPTZ": "DATETIME", "TIMESTAMP WITH TIME ZONE": "DATETIME", "SERIAL": "INTEGER", "BIGSERIAL": "INTEGER", "BOOL": "BOOLEAN",
    "INT8": "INTEGER", "INT16": "INTEGER", "INT32": "INTEGER", "INT64": "INTEGER", "UINT8": "INTEGER", "UINT16": "INTEGER", "UINT32": "INTEGER", "UINT64": "INTEGER",
    "FLOAT32": "REAL", "FLOAT64": "REAL", "DATETIME64": "DATETIME", "DECIMAL": "NUMERIC", "FIXEDSTRING": "TEXT",
}
SQLITE_OWN = "INTEGER INT BIGINT SMALLINT VARCHAR CHAR TEXT BOOLEAN REAL FLOAT DOUBLE DATE DATETIME TIMESTAMP BLOB NUMERIC".split()
