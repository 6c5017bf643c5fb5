"""Command line: run the controller and its REST interface."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from . import config as cfg
from .httpapi import server
from .service import Catalog, Service


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description="Keep time-bucketed aggregate views up to date.")
    p.add_argument("-c", "--config", default="config.yaml")
    p.add_argument("--views", default="views.yaml")
    p.add_argument("--warehouse", default="warehouse", help="folder of the tables; dotted names are folders below it")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = cfg.load_config(args.config)
    service = Service(spark, Catalog(spark, args.warehouse), config, args.config, args.views)
    service.start()
    http = server(service, config.port)
    try:
        http.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        http.server_close()
        service.close()


if __name__ == "__main__":
    main()
