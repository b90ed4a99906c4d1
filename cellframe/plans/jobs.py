"""The commands: what builds and checks each table of a day, a month or a window, and the lists that run them in order.

Tables lie below one root as ``sources.files.LAYOUTS`` says; what a command needs and doesn't find is an error of that command, which stops its list. A check
that fails stops nothing: its rows are appended to ``qa/checks``.

Sources: ``src/dim/*.csv`` (``;``-separated, columns of the contract), ``src/bs``, ``src/person/load_year=…/load_month=…/load_day=…``, ``src/excl/{column}``,
``src/marts/{centre}/{mart}/{YYYY}/{MM}/{DD}``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe import schemas
from cellframe.dq import suites
from cellframe.operators import profile
from cellframe.plans import bindings, cells, dims, events, persons, runner
from cellframe.sources import files
from cellframe.synth import generate

Step = tuple[str, Callable[[], object]]
CENTRES = ("central", "far-east")
IDENTIFIERS = ("msisdn", "imsi", "imei")
DIMENSIONS = {
    "oktmo": (schemas.DIM_OKTMO, dims.build_oktmo, suites.dim_oktmo), "time-zones": (schemas.DIM_TIME_ZONES, dims.build_time_zones, suites.dim_time_zones),
    "tac": (schemas.DIM_TAC, dims.build_tac, suites.dim_tac), "oksm": (schemas.DIM_OKSM, dims.build_oksm, suites.dim_oksm),
}


class Jobs:
    """Commands over one root. ``effective`` is the time that a snapshot of cells takes effect, given a day, so that a repeated run changes nothing."""

    def __init__(self, spark: SparkSession, root: str, centres: tuple[str, ...] = CENTRES, effective: Callable[[date], str] = lambda day: f"{day} 00:00:00", timing_path: str | None = None):
        self.spark, self.root, self.centres, self.effective = spark, root.rstrip("/"), centres, effective
        self.runner = runner.Runner(spark, timing_path)

    # tables

    def path(self, name: str, day: date | None = None, source: str = "") -> str:
        return files.layout_path(self.root, name, day, source)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def read_if(self, path: str) -> DataFrame | None:
        return self.read(path) if files.list_files(self.spark, path) else None

    def write(self, df: DataFrame, path: str) -> None:
        files.swap_write(self.spark, df, path)

    def check(self, name: str, results: DataFrame) -> None:
        results.withColumn("suite", F.lit(name)).withColumn("run_id", F.lit(self.runner.run_id)).write.mode("append").parquet(f"{self.root}/qa/checks")

    def present(self, path: str, suite: Callable[[DataFrame], DataFrame]) -> DataFrame:
        df = self.read_if(path)
        return suites.absent(self.spark) if df is None else suite(df)

    # dimensions and sources

    def dimension(self, name: str) -> list[Step]:
        schema, build, suite = DIMENSIONS[name]
        target = f"{self.root}/dim/{name}.parquet"

        def run():
            mapping = {f.name: (f.name, "string") for f in schema if f.name != "is_m2m"}
            self.write(build(files.read_dimension_csv(self.spark, f"{self.root}/src/dim/{name}.csv", mapping)), target)

        return [(f"build-dim-{name}", run), (f"dq-dim-{name}", lambda: self.check(f"dq-dim-{name}", self.present(target, suite)))]

    def snapshot(self, month: date) -> DataFrame:
        return self.read(files.latest_complete_snapshot(self.spark, f"{self.root}/src/person", month.year, month.month))

    def exclusions(self) -> dict[str, DataFrame | None]:
        return {c: self.read_if(f"{self.root}/src/excl/{c}") for c in IDENTIFIERS}

    def mart(self, centre: str, kind: str, day: date) -> DataFrame | None:
        root = f"{self.root}/src/marts/{centre}/{kind}"
        paths = files.near_day(self.spark, files.list_files(self.spark, root), day)
        return self.read(paths[0]).limit(0).unionByName(self.spark.read.option("mergeSchema", True).parquet(*paths), allowMissingColumns=True) if paths else None

    def marts(self, centre: str, day: date) -> dict[str, DataFrame]:
        return {k: m for k in events.CODES if (m := self.mart(centre, k, day)) is not None}

    def src(self, day: date, people: int = 1000, n_cells: int = 300, seed: int = 1) -> list[Step]:
        """Synthetic sources of a day."""

        def bs():
            self.write(generate.cells(self.spark, n_cells, seed), f"{self.root}/src/bs")

        def person():
            folder = f"{self.root}/src/person/load_year={day.year}/load_month={day.month:02d}/load_day={day.day:02d}"
            self.write(generate.person_versions(generate.subscribers(self.spark, people, seed), seed=seed), folder)

        def excl():
            some = dims.sample_exclusions(self.snapshot(day).withColumnRenamed("isdn", "msisdn"), seed=seed)
            for c in IDENTIFIERS:
                self.write(some.select(F.col(c).alias("value")).dropna().distinct(), f"{self.root}/src/excl/{c}")

        def marts():
            raw, everyone = self.read(f"{self.root}/src/bs"), self.snapshot(day)
            for i, centre in enumerate(self.centres):
                some = everyone.where(F.pmod(F.xxhash64("isdn"), F.lit(len(self.centres))) == i).dropDuplicates(["isdn"])
                made = generate.cross_mart_noise({k: generate.mart(self.spark, some, raw, k, day, seed=seed) for k in events.CODES}, seed=seed)
                for kind, df in made.items():
                    self.write(df, f"{self.root}/src/marts/{centre}/{kind}/{day:%Y/%m/%d}")

        return [("build-src-bs", bs), ("build-src-person", person), ("build-src-excl", excl), ("build-src-marts", marts)]

    # stages

    def stage_1(self, day: date) -> list[Step]:
        """Marts checked, events built for each centre, moved into the common layout."""

        def check():
            for centre in self.centres:
                self.check(f"dq-src-marts.{centre}", suites.src_marts(self.marts(centre, day)))

        def build():
            for centre in self.centres:
                if found := self.marts(centre, day):
                    self.write(events.build_events(found, day), self.path("dds/event", day, centre))

        def move():
            for centre in self.centres:
                files.move_event(self.spark, self.path("dds/event", day, centre), f"{self.root}/dds/event_dds", centre, day)

        return [("dq-src-marts", check), ("build-dds-event", build), ("build-dds-move-event", move)]

    def events_near(self, day: date) -> DataFrame:
        return files.read_partitions(self.spark, f"{self.root}/dds/event_dds", day)

    def stage_2(self, day: date) -> list[Step]:
        """Dimensions, cells, geo events, bindings and stays of a day, each checked."""
        bs, geo, stays = self.path("fct/bs"), self.path("stg/geo_all", day), self.path("fct/geo_intervals", day)
        imei, imsi = self.path("fct/msisdn_imei", day), self.path("fct/msisdn_imsi", day)
        zones = lambda: self.read(f"{self.root}/dim/time-zones.parquet")

        def build_bs():
            snapshot = cells.build_snapshot(self.prepared_cells(), zones(), self.read_if(f"{self.root}/dim/oktmo.parquet"))
            history = self.read_if(bs)
            self.write(cells.merge_snapshot(schemas.empty(self.spark, schemas.BS) if history is None else history, snapshot, F.lit(self.effective(day)).cast("timestamp_ntz")), bs)

        def bind(kind: str, target: str):
            self.write(bindings.upsert_day(self.read_if(target), files.read_geo_all_day(self.spark, geo), kind, day), target)

        def build_stays():
            self.write(events.build_geo_intervals(self.read(geo), self.read(imsi), self.read(imei), self.read(bs), zones(), day), stays)

        def check_events():
            e = self.events_near(day).where(F.col("report_date") == F.lit(day))
            self.check("dq-dds-event", suites.dds_event(e.drop("report_date", "source_id")).unionByName(suites.dds_event_by_source(e)))

        return [
            *self.dimension("oktmo"), *self.dimension("time-zones"), ("dq-src-bs", lambda: self.check("dq-src-bs", self.present(f"{self.root}/src/bs", suites.src_bs))),
            ("build-fct-bs", build_bs), ("dq-fct-bs", lambda: self.check("dq-fct-bs", self.present(bs, suites.fct_bs))), ("dq-dds-event", check_events),
            ("build-stg-geo-all", lambda: self.write(events.build_geo_all(self.events_near(day), self.read(bs), day), geo)), ("dq-stg-geo-all", lambda: self.check("dq-stg-geo-all", self.present(geo, suites.stg_geo_all))),
            ("build-fct-msisdn-imei", lambda: bind("imei", imei)), ("dq-fct-msisdn-imei", lambda: self.check("dq-fct-msisdn-imei", self.present(imei, suites.fct_msisdn_imei))),
            ("build-fct-msisdn-imsi-operator", lambda: bind("imsi", imsi)), ("dq-fct-msisdn-imsi-operator", lambda: self.check("dq-fct-msisdn-imsi-operator", self.present(imsi, suites.fct_msisdn_imsi))),
            ("build-fct-geo-intervals", build_stays), ("dq-fct-geo-intervals", lambda: self.check("dq-fct-geo-intervals", self.present(stays, suites.fct_geo_intervals))),
        ]

    def prepared_cells(self) -> DataFrame:
        clean, errors = cells.prepare(self.read(f"{self.root}/src/bs"))
        errors.write.mode("overwrite").parquet(f"{self.root}/qa/cell_errors")
        return clean

    def person(self, month: date) -> list[Step]:
        """Device types, countries, sources checked, and the profiles of a month."""
        first, last = persons.month_bounds(month)
        target = self.path("fct/person", first)

        def build():
            before = self.read_if(self.path("fct/person", runner.previous_month(first)))
            codes, names = dims.country_lookup(self.read(f"{self.root}/dim/oksm.parquet"))
            machines = self.read(f"{self.root}/dim/tac.parquet").where("is_m2m").select("tac")
            held = {c: x for c, x in self.exclusions().items() if x is not None}
            imsi, imei = (bindings.read_normalised(self.read(self.path(f"fct/msisdn_{k}", first)), k, open_end=True) for k in ("imsi", "imei"))
            self.write(persons.build_persons(self.snapshot(first), first, imsi, imei, before, held, machines, codes, names), target)

        def check_source():
            found = [p for p in files.list_files(self.spark, f"{self.root}/src/person", "_SUCCESS")]
            days = self.spark.createDataFrame([(p,) for p in found], "path string").select(files.day_of_path(F.col("path")).alias("day"))
            rows = [(d, self.read(f"{self.root}/src/person/load_year={d.year}/load_month={d.month:02d}/load_day={d.day:02d}").count(), True) for d in sorted(r["day"] for r in days.where("day is not null").collect())]
            inventory = self.spark.createDataFrame(rows, "day date, rows bigint, success boolean")
            self.check("dq-src-person", suites.src_person(self.snapshot(first), F.lit(last)).unionByName(suites.snapshot_inventory(inventory, F.lit(first), F.lit(last))))

        oksm = lambda: self.read(f"{self.root}/dim/oksm.parquet")
        return [
            *self.dimension("tac"), *self.dimension("oksm"), ("dq-src-excl", lambda: self.check("dq-src-excl", suites.src_exclusions(self.exclusions(), self.spark))), ("dq-src-person", check_source),
            ("build-fct-person", build), ("dq-fct-person", lambda: self.check("dq-fct-person", self.present(target, lambda df: suites.fct_person(df, oksm())))),
        ]

    def dashboard(self, suite: str) -> dict[str, DataFrame]:
        """Frames of a suite's checks: of the last run its statuses, failures, null rates and gates, and how each check went run by run."""
        log = self.read(f"{self.root}/qa/checks").where(F.col("suite") == suite).withColumn("logger", F.col("suite"))
        when = files.read_timings(self.spark, self.runner.timing_path).groupBy("run_id").agg(F.max("ts_utc").alias("at")) if self.runner.timing_path else log.groupBy("run_id").agg(F.lit("").alias("at"))
        runs = when.withColumn("run", F.dense_rank().over(Window.orderBy("at", "run_id")))
        log = log.join(runs, "run_id")
        last = log.join(log.agg(F.max("run").alias("run")), "run")
        return {"status": runner.status_counts(last), "failures": runner.failures(last), "nulls": runner.null_ratios(last), "rates": runner.rates(last), "history": runner.check_history(log)}

    def table_profile(self, path: str, numbers: list[str], words: list[str]) -> dict[str, DataFrame]:
        """Frames of a table itself: null rates, summaries of numbers, most frequent values."""
        df = self.read(path)
        return {"nulls": profile.null_rates(df, df.columns), "numbers": profile.numeric_profile(df, numbers), **{c: profile.value_counts(df, c, 20) for c in words}}

    def commands(self, day: date) -> dict[str, Callable[[], object]]:
        """Every command of a day and its month by name."""
        return dict([*self.src(day), *self.stage_1(day), *self.stage_2(day), *self.person(day.replace(day=1))])

    def run(self, steps: list[Step]) -> list[dict]:
        return self.runner.run(steps)

    def run_all(self, first: date, last: date) -> list[dict]:
        """Stages 1 and 2 of every day of a window, then the profiles of its months."""
        for day in runner.days(first, last):
            self.run([*self.stage_1(day), *self.stage_2(day)])
        for month in runner.months(first, last):
            self.run(self.person(month))
        return self.runner.timings
