"""opineflow.plans"""
