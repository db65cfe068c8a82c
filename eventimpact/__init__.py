"""eventimpact — Spark-native analytics for traffic incidents and planned city events.

Every operator is a pure function ``DataFrame -> DataFrame`` (or ``Column -> Column``) built on
the DataFrame / SQL API, Spark ML or Structured Streaming. Nothing is collected to the driver.
"""

__version__ = "0.1.0"
