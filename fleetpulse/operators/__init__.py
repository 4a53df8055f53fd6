"""fleetpulse.operators"""
