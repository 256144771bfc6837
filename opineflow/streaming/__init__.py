"""opineflow.streaming"""
