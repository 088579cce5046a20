"""Shared test helpers."""

import datetime as dt

import numpy as np

AS_OF = dt.date(2026, 1, 1)
DATA = "/root/testdata"


def found(issues) -> dict:
    """{(column, issue type): affected rows}"""
    return {(r["column_name"], r["issue_type"]): r["affected_rows"] for r in issues.collect()}


def log(fixed) -> dict:
    return {(r["action"], r["column_name"]): r["rows_affected"] for r in fixed.log.collect()}


def common_subsequence(a: str, b: str) -> int:
    row = np.zeros(len(b) + 1, int)
    points = np.array(list(b))
    for x in a:
        diagonal = np.append(0, row[:-1] + (points == x))
        row = np.maximum.accumulate(np.maximum(row, diagonal))
    return int(row[-1])


def indel(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b))
