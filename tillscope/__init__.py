"""tillscope: retail invoice analytics as Spark DataFrame jobs.

Cleans and de-duplicates invoice lines, offsets cancellations against the
latest earlier purchase, groups products, scores customers on recency /
frequency / spend, trains and explains segment classifiers and answers
period report questions.  Every stage is a function DataFrame -> DataFrame.
"""

from tillscope.params import Params

__all__ = ["Params"]
