"""Registry of gate queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from gate.corpus import ROW_PX, VIEWPORT, landing_pages, web_pages
from pagelode.operators.detect import Detectors
from pagelode.operators.elements import Document
from pagelode.plans.sections import Sections
from pagelode.session import tune

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def layout():
    """Boxes of the stand-in renderer; see gate.corpus."""
    return {"x": F.lit(0), "y": F.col("seq") * ROW_PX}


_KEPT: dict[tuple, Document] = {}


def _kept(kind: str, spark, sf_dir, make) -> Document:
    """Queries over one table share its persisted tokens, as one job would."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = make().keep()
    return _KEPT[key]


def snapshot(spark, sf_dir) -> Document:
    """Derived landing pages with the stand-in renderer's geometry."""
    return _kept("snapshot", spark, sf_dir, lambda: Document(landing_pages(spark, sf_dir), layout(), VIEWPORT))


def markup(spark, sf_dir) -> Document:
    """The same pages without geometry; the tokens do not depend on it."""
    one = snapshot(spark, sf_dir)
    return Document(landing_pages(spark, sf_dir), tables={k: getattr(one, k) for k in ("tokens", "nodes", "texts", "text_pieces", "base")}).keep(one.buckets)


def web(spark, sf_dir) -> Document:
    return _kept("web", spark, sf_dir, lambda: Document(web_pages(spark, sf_dir)))


def forget() -> None:
    """Build everything anew from here on."""
    for kept in (_KEPT, _DET, _SEC):
        kept.clear()


_DET: dict[int, Detectors] = {}


def detectors(spark, sf_dir) -> Detectors:
    doc = snapshot(spark, sf_dir)
    return _DET.setdefault(id(doc), Detectors(doc))


_SEC: dict[int, Sections] = {}


def sections(spark, sf_dir) -> Sections:
    det = detectors(spark, sf_dir)
    return _SEC.setdefault(id(det), Sections(det))


def web_sections(spark, sf_dir) -> Sections:
    doc = web(spark, sf_dir)
    det = _DET.setdefault(id(doc), Detectors(doc))
    return _SEC.setdefault(id(det), Sections(det))
