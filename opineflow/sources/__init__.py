"""opineflow.sources"""
