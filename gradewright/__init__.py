"""gradewright: learning-analytics and text-corpus operators on Spark DataFrames."""
