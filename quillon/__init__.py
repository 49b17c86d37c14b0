"""quillon: set-semantic relational algebra, ordered-sequence operators, a property-graph
layer and line-oriented text operators on Spark DataFrames."""
