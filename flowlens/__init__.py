"""flowlens: distributed analytics for labelled network-flow tables on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (sometimes returning a
second, small, lazily evaluated statistics DataFrame).  Nothing is collected to
the driver except bounded summaries (class lists, feature lists, bucket bounds).
"""

__version__ = "0.1.0"
