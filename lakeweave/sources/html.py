"""A page that shows which tables duplicate each other."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_page(relations: DataFrame, cells: DataFrame, headers: DataFrame, rows: int = 5, most: int = 500) -> str:
    """HTML with one section per table of a relation: its partners as links and its first rows.

    For the result of a search: ValueError if it has more than ``most`` pairs.
    The first rows of all tables are read in one job.
    """
    found = relations.select("tableid_1", "tableid_2").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} pairs are too many for a page")
    partners: dict[int, set[int]] = {}
    for a, b in found:
        partners.setdefault(a, set()).add(b)
        partners.setdefault(b, set()).add(a)
    ids = list(partners)
    names: dict[int, dict[int, str]] = {}
    values: dict[int, dict[int, dict[int, str]]] = {}
    if ids:
        for r in headers.where(F.col("tableid").isin(ids)).select("tableid", "colid", "header").collect():
            names.setdefault(r.tableid, {})[r.colid] = r.header
        for r in cells.where(F.col("tableid").isin(ids) & (F.col("rowid") < rows)).select("tableid", "rowid", "colid", "token").collect():
            values.setdefault(r.tableid, {}).setdefault(r.rowid, {})[r.colid] = r.token
    out = ["<!DOCTYPE html><meta charset='utf-8'><title>Duplicate tables</title>"]
    for t, others in sorted(partners.items()):
        links = ", ".join(f"<a href='#t{o}'>{o}</a>" for o in sorted(others))
        cols = sorted(names.get(t, {}))
        lines = [f"<tr>{''.join(f'<th>{escape(str(names[t][c]))}</th>' for c in cols)}</tr>"]
        lines += [f"<tr>{''.join(f'<td>{escape(str(row.get(c)))}</td>' for c in cols)}</tr>" for _, row in sorted(values.get(t, {}).items())]
        out.append(f"<h2 id='t{t}'>Table {t}</h2><p>Same rows as {links}</p><table>{''.join(lines)}</table>")
    return "\n".join(out)
