"""nearspan: approximate sequence search and corpus preparation as Spark plans."""
