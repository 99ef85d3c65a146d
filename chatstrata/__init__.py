"""Fleet-wide analytics and maintenance of chat-session log archives on Spark.

Every table carries ``root_id`` (one log directory of one user or machine) and
every operator is a pure function from DataFrames to DataFrames, so one job
serves a single root or a whole fleet.
"""
