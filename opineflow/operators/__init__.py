"""opineflow.operators"""
