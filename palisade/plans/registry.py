"""All registered queries of the evidence engine, and their SQL."""

from palisade.plans import evidence, logs, readings

QUERIES = {**logs.QUERIES, **evidence.QUERIES, **readings.QUERIES}
ORACLES = {**logs.ORACLES, **evidence.ORACLES, **readings.ORACLES}
