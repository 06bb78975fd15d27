"""Model-validity analytics on Spark: how long will a frozen model keep meeting its risk limit?"""
