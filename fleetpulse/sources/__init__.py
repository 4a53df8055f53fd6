"""fleetpulse.sources"""
