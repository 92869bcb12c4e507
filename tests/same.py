"""Compares two frames as bags of rows."""

import math


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("int64", "float64", "int32", "float32", "Decimal"):
        return f"{float(v) + 0.0:.5g}" if abs(float(v) - round(float(v))) > 1e-9 else str(int(round(float(v))))
    if type(v).__name__ == "bool_":
        return str(bool(v))
    if type(v).__name__ in ("NAType", "NaTType"):
        return "null"
    return str(v)


def rows(df, columns):
    return sorted(tuple(_cell(v) for v in r) for r in df[columns].itertuples(index=False, name=None))


def assert_same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(got.columns)
    a, b = rows(got, columns), rows(expected, columns)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (columns, bad[:3])
