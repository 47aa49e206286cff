"""tallyflow: prequential Naive Bayes text analytics as declarative Spark plans."""
