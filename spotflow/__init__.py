"""spotflow: mobility and occupancy analytics as Spark DataFrame operators."""
