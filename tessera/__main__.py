"""Command line: run, replay, inject, synthesize and sql over folders of landed bars.

    python -m tessera run    --root DIR --source s1=bars1.parquet --source fx=rates.parquet --kind fx=rates --run-id r1 [--date 2024-01-02] [--refetch s1=again.parquet] [--config FILE]
    python -m tessera replay --root DIR --run-id r1
    python -m tessera inject SCENARIO --root DIR --source s1=bars1.parquet
    python -m tessera freeze --root DIR --source s1=bars1.parquet --tag TAG
    python -m tessera synthesize --root DIR --source s1 --instrument A --instrument B [--date 2024-01-02]
    python -m tessera sql    --root DIR "SELECT ..."

A run takes the bars of one date, yesterday unless given, or all with ``--date all``.  It leaves the export of its
lineage, a report page and a few words on what happened in DIR.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config as settings
from tessera.operators import audit, inject
from tessera.plans import engine
from tessera.session import session
from tessera.sources import schemas
from tessera.sources.layers import Fixtures, Layers


def _pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "replay", "inject", "freeze", "synthesize", "sql"):
        own = commands.add_parser(name)
        own.add_argument("--root", required=True)
        own.add_argument("--config")
        if name in ("run", "replay"):
            own.add_argument("--run-id", required=True)
        if name in ("run", "inject", "freeze"):
            own.add_argument("--source", action="append", default=[], metavar="ID=PATH")
        if name in ("run", "synthesize"):
            own.add_argument("--date", default=str(datetime.date.today() - datetime.timedelta(days=1)))
        if name == "run":
            own.add_argument("--kind", action="append", default=[], metavar="ID=KIND", help=f"one of {', '.join(engine.NORMALISERS)}; price unless given")
            own.add_argument("--refetch", action="append", default=[], metavar="ID=PATH", help="where a suspected source is read again; the source itself unless given")
        if name == "synthesize":
            own.add_argument("--source", action="append", default=[], metavar="ID")
            own.add_argument("--instrument", action="append", default=[])
        if name == "inject":
            own.add_argument("scenario")
        if name == "freeze":
            own.add_argument("--tag", required=True)
        if name == "sql":
            own.add_argument("text")
    given = parser.parse_args(arguments)
    settings.refuse_secrets()
    spark = session()
    layers, fixtures = Layers(spark, given.root), Fixtures(spark, f"{given.root}/fixtures")
    if given.command == "synthesize":
        for source in given.source:
            print(fixtures.snapshot(source, inject.synthetic_bars(spark, given.instrument, given.date), "synthetic"))
        return 0
    sources = _pairs(getattr(given, "source", []))
    config = settings.load(given.config)
    if given.command == "run":
        kinds, again = _pairs(given.kind), sources | _pairs(given.refetch)
        if not given.config and sources:
            config = settings.Config(sources=tuple(settings.Source(s, reference=kinds.get(s, "price") != "price") for s in sources))

        def of_date(path: str, days: int = 0) -> DataFrame:
            rows = spark.read.parquet(path)
            if given.date == "all" or "Date" not in rows.columns:
                return rows
            last = F.lit(given.date).cast("date")
            return rows.filter(F.to_date("Date").between(F.date_sub(last, days), last))

        def refetch(source: str, days: int) -> DataFrame | None:
            try:
                return engine.NORMALISERS[kinds.get(source, "price")](of_date(again[source], days), source) if source in again else None
            except (KeyError, AnalysisException):
                return None  # a failed attempt

        result = engine.run(spark, layers, {s: of_date(p) for s, p in sources.items()}, config, given.run_id, kinds, refetch)
        audit.to_json(result.lineage, result.scorecard).write.mode("overwrite").text(f"{given.root}/lineage/{given.run_id}")
        told = audit.narrative(audit.topic_counts(result.events))
        for name, text in ((f"report/{given.run_id}.html", audit.to_html(result.scorecard, result.lineage)), (f"report/{given.run_id}.txt", told)):
            layers.write_text(name, text)
        print(told)
        result.scorecard.orderBy("business_date", "source_id").show(truncate=False)
        return 0
    if given.command == "replay":
        gold = layers.read("silver").select("source_id").distinct().collect()  # one row per source
        if not given.config:
            config = settings.Config(sources=tuple(settings.Source(r.source_id) for r in gold))
        differing = engine.replay(layers, given.run_id, config).count()
        print("identical" if not differing else f"{differing} rows differ")
        return int(differing > 0)
    if given.command in ("inject", "freeze"):
        for source, path in sources.items():
            if given.command == "freeze":
                print(fixtures.snapshot(source, spark.read.parquet(path), given.tag))
            else:
                print(fixtures.snapshot(source, inject.scenario(spark.read.schema(schemas.BRONZE).parquet(path), given.scenario), "default"))
        return 0
    layers.sql(given.text).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
