"""Small observation tables written as plain rows."""

import datetime as dt

from tidemark import schemas

LOINC = "http://loinc.org"


def ts(text):
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None


def observations(spark, rows, subject="s1"):
    """Rows of (code, start, end, value[, archive_key[, subject]])."""
    out = []
    for i, row in enumerate(rows):
        code, start, end, value, *more = row
        key = more[0] if more else "doc"
        who = more[1] if len(more) > 1 else subject
        out.append((who, key, i, LOINC, code, None, ts(start), ts(end), value, None, None))
    return spark.createDataFrame(out, schemas.OBSERVATIONS)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
